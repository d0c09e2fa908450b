import hashlib
from collections import Counter

from scenemill.llm.exact_dedup import exact_dedup, keep_distinct

from .cases import SCHEMA, awkward, frame


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out, seen = [], set()
    for r in rows:
        ids = groups[r[1] or ""]
        kept = r[0] == max(ids) and (r[0], r[1] or "") not in seen
        if kept:
            seen.add((r[0], r[1] or ""))
        out.append((r[0], max(ids), len(ids), kept, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


def test_awkward_rows(spark):
    rows = awkward()
    got = [tuple(r) for r in exact_dedup(frame(spark, rows, extra=True)).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_equal_lengths_and_prefixes_are_told_apart(spark):
    head = "p" * 64
    rows = [(i, head + c, "en", "a", 1) for i, c in enumerate("abcab")]
    got = {r[0]: tuple(r)[1:4] for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {0: (3, 2, False), 1: (4, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 2, True)}


def test_digest_only_where_needed(spark):
    rows = [(1, "a", "", "", 1), (2, "bb", "", "", 1), (3, "bb", "", "", 1)]
    got = {r[0]: r["text_sha256"] for r in exact_dedup(frame(spark, rows), report_digest=False).collect()}
    assert got[1] is None and got[2] == got[3] == hashlib.sha256(b"bb").hexdigest()


def test_keep_distinct_keeps_all_columns(spark):
    rows = awkward()
    kept = keep_distinct(frame(spark, rows, extra=True))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "kept" in kept.columns
    assert Counter(r[0] for r in kept.collect()) == Counter(r[0] for r in brute(rows) if r[3])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).collect() == [] and keep_distinct(empty).collect() == []
