import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from scenemill.llm.bitslice import forest, pairs_within
from scenemill.llm.components import connected_components
from scenemill.llm.simhash import blocks_for, fingerprint, keep_one_of_near, links, simhash_near_duplicates

from .cases import SCHEMA, awkward, frame


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_values(rng, n, radius):
    values = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(values)
        for b in rng.sample(range(64), rng.randrange(radius + 3)):
            x ^= 1 << b
        values.append(x)
    return list(dict.fromkeys(values))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    values = near_values(rng, 300, radius)
    a = np.array(values, np.uint64)
    b = np.roll(a, 5)
    want = [(int(x) ^ int(y)).bit_count() <= radius for x, y in zip(a, b)]
    assert pairs_within(a, b, radius, chunk=100).tolist() == want
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius]
    assert roots(range(len(values)), forest(a, radius)) == roots(range(len(values)), pairs)


def test_fingerprints_match_the_definition():
    for row in awkward():
        if row[1] is not None and len(row[1]) < 20000:
            assert fingerprint(row[1].encode()) == slow_fingerprint(row[1])


def test_keys_are_as_long_as_the_number_of_fingerprints():
    for n in (10, 10**6, 10**8, 10**10):
        blocks = blocks_for(n, 4)
        assert (blocks - 4) * 64 // blocks >= min(n.bit_length(), 38)


@pytest.mark.parametrize("wide", [1, 2, 3])
def test_wide_distances(wide):
    rng = random.Random(wide)
    values = [rng.getrandbits(64 * wide) for _ in range(90)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64 * wide), rng.randrange(14))) for v in values]
    parts = np.array([[v >> 64 * (wide - 1 - k) & (1 << 64) - 1 for k in range(wide)] for v in values], np.uint64)
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 9]
    assert roots(range(len(values)), forest(parts, 9)) == roots(range(len(values)), pairs)
    want = [(a ^ b).bit_count() <= 9 for a, b in zip(values, values[90:] + values[:90])]
    assert pairs_within(parts, np.roll(parts, -90, axis=0), 9).tolist() == want


@pytest.mark.parametrize("blocks", [None, 6, 8])
@pytest.mark.parametrize("chunk", [4096, 20])
def test_links_lose_no_component(spark, chunk, blocks):
    values = near_values(random.Random(3), 150, 4)
    centre = random.Random(4).getrandbits(64)
    values += [centre ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(i)]
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = connected_components(links(df, chunk=chunk, blocks=blocks)).collect()
    got = {n: n for n in signed} | {r.u: r.root for r in found}
    pairs = [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert got == roots(signed, pairs)


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(5, 5), (70, 71), (71, 70)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.u: r.root for r in found} == {**{i: 0 for i in range(1, 61)}, 71: 70}


def brute(rows):
    prints = [(r[0], slow_fingerprint(r[1] or "")) for r in rows]
    distinct = sorted({f for _, f in prints})
    comp = roots(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in prints:
        least[comp[f]] = min(i, least.get(comp[f], i))
    return [(i, f"{f:016x}", least[comp[f]]) for i, f in prints]


def test_awkward_rows(spark):
    rows = awkward()
    got = [tuple(r) for r in simhash_near_duplicates(frame(spark, rows, extra=True)).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_one_of_each_group_stays(spark):
    rows = awkward()
    kept = keep_one_of_near(frame(spark, rows, extra=True))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r[0] for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_near_duplicates(empty).collect() == [] and keep_one_of_near(empty).collect() == []
