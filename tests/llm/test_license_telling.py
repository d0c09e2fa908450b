import pytest

from scenemill.llm.license_scan import COVERAGE, TEMPLATES, UNKNOWN, Scanner

SCAN = Scanner(TEMPLATES, COVERAGE)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the BSD License.", "BSD"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
        ("Released under MIT License.", "MIT"),
        ("The album was released under the artist's own license.", None),
        ("Released under the Eclipse License.", UNKNOWN),
        ("Licensed under the Apache License, Version 1.0.", UNKNOWN),
        ("This work is licensed under the GNU General Public License, version 1.", UNKNOWN),
    ],
)
def test_words_that_name_the_license(text, want):
    found = [f.license for f in SCAN.scan("some words before\n" + text + "\nand some after")]
    assert set(found) <= {want, UNKNOWN} if want is None else found == [want]
