import hashlib
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from scenemill.llm.order_minhash import ELEMENTS, KMER, TOKEN_CHARS, TUPLE, as_hex, compare_with_edits, likeness, signature

from .cases import SCHEMA, awkward, frame

MASK = (1 << 64) - 1
PLACE = (1 << 24) - 1


def spark_hash(*longs):
    """Spark chains hashes: each value is hashed with the hash so far as its seed; a long is hashed as 8 bytes."""
    h = 42
    for v in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", v & MASK) if isinstance(v, int) else v.encode(), h)
    return h


def int_hash(h, v):
    """Spark hashes an int as 4 bytes."""
    return xxhash.xxh64_intdigest(struct.pack("<I", v), h)


def tokens(text):
    return [w[i : i + TOKEN_CHARS] for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w for i in range(0, len(w), TOKEN_CHARS)]


def slow_signature(text):
    """By the definition: every numbered k-mer for every rotation."""
    words = [spark_hash(w) for w in tokens(text)]
    n = max(len(words) - KMER + 1, min(len(words), 1))
    if not n:
        return []
    seen, kmers = Counter(), []
    for i in range(n):
        kmer = spark_hash(*words[i : i + KMER]) & ~PLACE & MASK
        seen[kmer] += 1
        number = seen[kmer] - 1
        value = kmer if not number else int_hash(spark_hash(kmer), number) & ~PLACE & MASK
        kmers.append((value, i + 1))
    out = []
    for j in range(ELEMENTS):
        threshold = ((1 << 63) + j * ((1 << 64) // ELEMENTS)) & MASK  # the first is the lowest signed long
        least = sorted(kmers, key=lambda k: ((k[0] - threshold) & MASK, k[1]))
        taken = [least[t % n] for t in range(TUPLE)]
        in_order = [v >> 24 for v, _ in sorted(taken, key=lambda k: (k[1], k[0]))]
        out.append(spark_hash(*in_order))
    return out


def texts():
    rng = random.Random(5)
    made = [r[1] for r in awkward(40) if r[1] and len(r[1]) < 10000]
    made += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)] + ["a " * 300, "", " \t"]
    return made


def test_signatures_match_the_definition(spark):
    made = texts()
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string")
    got = {r.i: [x & MASK for x in r.s] for r in df.select("i", signature(F.col("t")).alias("s")).collect()}
    for i, text in enumerate(made):
        assert got[i] == slow_signature(text), text[:80]


def test_likeness_follows_edits(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(800)]
    few, many = list(base), list(base)
    for i in rng.sample(range(800), 8):
        few[i] = "changed"
    for i in rng.sample(range(800), 200):
        many[i] = f"other{i}"
    turned = base[400:] + base[:400]
    other = [rng.choice(vocabulary) for _ in range(800)]
    rows = [(" ".join(base), " ".join(x)) for x in (base, few, many, other, turned)]
    df = spark.createDataFrame(rows, "a string, b string")
    same, slight, strong, none, moved = [r[0] for r in df.select(likeness(signature(F.col("a")), signature(F.col("b")))).collect()]
    assert same == 1.0 and slight > 0.75 > strong > none and none < 0.05 and moved < slight


def test_dense_scripts_are_cut_by_character(spark):
    text = "".join(chr(0x4E00 + i * 7 % 900) for i in range(400))
    df = spark.createDataFrame([(text, "前" + text)], "a string, b string")
    assert df.select(likeness(signature(F.col("a")), signature(F.col("b")))).first()[0] > 0.8


def brute(rows):
    keys = {}
    for r in rows:
        text = r[1] or ""
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        h = int_hash(h, int(r[0] is None))
        keys[(r[0], h - (1 << 64) if h >> 63 else h)] = text
    order = sorted(keys, key=lambda k: (k[0] is None, -(k[0] or 0), k[1]))
    out = {}
    for k, following in zip(order, order[1:] + order[:1]):
        text, after = keys[k], keys[following]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        out[(k[0], text)] = (edited, after)
    result = []
    for r in rows:
        text = r[1] or ""
        edited, after = out[(r[0], text)]
        a, b, c = (slow_signature(x) for x in (text, edited, after))
        alike = lambda x, y: 1.0 if not x and not y else sum(p == q for p, q in zip(x, y)) / max(len(x), len(y))
        digits = lambda s: "".join(f"{v & 0xFFFFFFFF:08x}" for v in s)
        result.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(a), digits(b), alike(a, b), alike(a, c)))
    return Counter(result)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_awkward_rows(spark, n):
    rows = [r for r in awkward(n) if r[0] != 206] + [(None, "no id here at all", "en", "a", 1)] if n > 2 else awkward(n)[:n]
    got = compare_with_edits(frame(spark, rows, extra=True)).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_only_dataframe_operations(spark, capsys):
    df = compare_with_edits(frame(spark, awkward(5)))
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hex_has_eight_digits(spark):
    df = spark.createDataFrame([("a b c",)], "t string")
    assert len(df.select(as_hex(signature(F.col("t")))).first()[0]) == 8 * ELEMENTS


def test_empty_table(spark):
    assert compare_with_edits(spark.createDataFrame([], SCHEMA)).collect() == []
