import random
from collections import Counter

import pytest

from scenemill.llm.license_scan import COVERAGE, TEMPLATES, Scanner, _longest_increasing, patience, scan_licenses, words_of

from .cases import SCHEMA, awkward, frame, prose


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_increasing():
    rng = random.Random(0)
    for _ in range(300):
        values = [rng.randrange(12) for _ in range(rng.randrange(10))]
        got = [values[i] for i in _longest_increasing(values)]
        chosen = [[v for i, v in enumerate(values) if m >> i & 1] for m in range(1 << len(values))]
        best = max(len(s) for s in chosen if all(x < y for x, y in zip(s, s[1:])))
        assert len(got) == best and all(x < y for x, y in zip(got, got[1:]))


def test_patience_is_an_alignment():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(14))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(14))]
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == lcs(a, b)
    assert len(patience(list("abcdef"), list("abXdef"))) == 5


@pytest.mark.parametrize("k", range(len(TEMPLATES)))
def test_every_template_is_found_in_a_long_text(k):
    rng = random.Random(k)
    name, notice = TEMPLATES[k]
    before, after = prose(rng, 3000) + "\n", "\n" + prose(rng, 3000) + "\n"
    found = Scanner(TEMPLATES, COVERAGE).scan(before + notice + after + notice.upper() + after)
    assert [f.license for f in found] == [name, name]
    assert all(f.coverage == 1.0 for f in found)
    assert found[0].start == len(before) and found[0].end <= len(before) + len(notice)


def test_edited_notices_by_their_coverage():
    scan = Scanner(TEMPLATES, COVERAGE)
    words = TEMPLATES[3][1].split()
    rng = random.Random(3)
    for drop, want in ((5, True), (len(words) // 2, False)):
        out = set(rng.sample(range(len(words)), drop))
        text = "preface here " + " ".join("zzz" if i in out else w for i, w in enumerate(words)) + " end"
        assert bool(scan.scan(text)) == want
        if want:
            assert scan.scan(text)[0].coverage >= 0.9
    assert scan.scan("A short MIT mention, no notice; the license of the apache tribe.") == []


def test_short_notices_lacking_one_word():
    scan = Scanner(TEMPLATES, COVERAGE)
    for name, text in TEMPLATES:
        words = words_of(text)[0]
        if 5 <= len(words) <= 12:
            for i in range(len(words)):
                changed = " ".join("zzz" if j == i else w for j, w in enumerate(words))
                assert scan.scan("aa bb " + changed + " cc dd"), changed


def test_awkward_rows(spark):
    rows = awkward() + [(300, "x\nReleased under the MIT License.\nReleased under the MIT License.", "en", "a", 1), (301, "é Licensed under the Apache License, Version 2.0.", "en", "a", 1)]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows, extra=True)).collect()}
    assert Counter(r[0] for r in rows).keys() == got.keys()
    assert got[200].n_notices == got[201].n_notices == 0 and got[200].license is None and got[200].notices == ""
    assert (got[300].n_notices, got[300].license, got[300].start, got[300].notices) == (2, "MIT", 2, "MIT:2:32,MIT:34:64")
    assert (got[301].license, got[301].coverage, got[301].start) == ("Apache-2.0", 1.0, 2)
    assert scan_licenses(frame(spark, rows)).count() == len(rows)


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
