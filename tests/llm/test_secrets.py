import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scenemill.llm.automaton import compile_rules
from scenemill.llm.secrets import BASE_KINDS, RULES, find_secrets, scanner, secret_report

from .cases import SCHEMA, awkward, frame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password", "((?i:password").replace("api_?key)", "api_?key))"))
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
PIECES = ["password", "PASSWD", "token", "api_key", "ApiKey", "secret", "=", ":", " ", "  ", '"', "'", "AKIA", "abcdef0123456789", "0123456789abcdef0", "X9Z8", "é", "\n", "long-value_1", "abc", "tok", "==", "ABCDEFGH1234", "漢", "-"]


def brute(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(found)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_are_those_of_the_regexes(text):
    assert [s for s in scanner(RULES).spans(text) if s[0] in BASE_KINDS] == brute(text)


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[^a]b{2,3}c?", r"x+y\x20[0-9]{3}", "(ab|abc)(d|cd)", "a{2}", "(?:a|b)+c"])
def test_automata_match_re(pattern):
    rng = random.Random(1)
    whole, anywhere, back = compile_rules([(pattern, False)], False), compile_rules([(pattern, False)], True), compile_rules([(pattern, False)], False, True)
    regex = re.compile(pattern)
    for _ in range(800):
        text = "".join(rng.choice("abcdxy 01") for _ in range(rng.randrange(9)))
        data = text.encode()
        ends = [e for e in range(len(text) + 1) if regex.fullmatch(text, 0, e)]
        assert whole.longest(data, 0, len(data)) == (max(ends) if ends else None)
        state, hits = anywhere.start, []
        for i, c in enumerate(data.translate(anywhere.classes)):
            state = anywhere.table[state + c]
            if state >= anywhere.accepting:
                hits.append(i + 1)
        assert hits == [e for e in range(1, len(text) + 1) if any(regex.fullmatch(text, s, e) for s in range(e))]
        if text and hits and hits[-1] == len(text):
            starts = [s for s in range(len(text)) if regex.fullmatch(text, s)] or [s for s in range(len(text)) if regex.fullmatch(text, s, len(text))]
            assert back.longest(data, len(data) - 1, -1, -1) + 1 == min(starts)


def test_added_rules():
    text = f"x gh{'p_' + 'z1' * 18} xoxb-12345678901234567890 AIza{'x' * 35} sk_live_{'0' * 24} -----BEGIN RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM gh{'p_short'}"
    kinds = [k for k, _, _ in scanner(RULES).spans(text)]
    assert kinds == ["github", "slack", "google", "stripe", "private_key", "jwt"]


def test_awkward_rows(spark):
    rng = random.Random(2)
    rows = awkward() + [(300 + i, "".join(rng.choice(PIECES) for _ in range(200)), "en", "a", 1) for i in range(20)]
    got = secret_report(frame(spark, rows, extra=True))
    want = Counter()
    for r in rows:
        spans = brute(r[1] or "")
        n = Counter(k for k, _, _ in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in scanner(RULES).spans(r[1] or ""))
        want[(r[0], n["assign"], n["access"], n["hex"], digest, joined)] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert secret_report(empty).collect() == [] and find_secrets(empty).collect() == []


def test_many_spans_after_wide_characters():
    text = "漢é token=abcdefgh1 " * 3000
    found = scanner().spans(text)
    own = [(k, a, b) for k, a, b in found if k == "assign"]
    assert len(own) == 3000 and [text[a:b] for _, a, b in own] == ["token=abcdefgh1"] * 3000
