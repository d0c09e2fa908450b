import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from scenemill.llm.pareto_mix import mixed, pareto_mix, source_targets

from .cases import SCHEMA, awkward, frame


def targets_by_rounds(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, cap, reshare the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return {**capped, **{s: level * weight[s] for s in open_}}
        capped.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 10, "b": 1000, "c": 5, None: 400}, {"a": 0, "b": 0}, {"é": 7, "Z": 900, "z": 30, "": 1, "zz": 60}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(targets_by_rounds(sizes))


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows):
    """The mix by its definition, one source at a time."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0], count(r[1])))
    sizes = {s: sum(n for _, n in docs) for s, docs in by_source.items()}
    target = targets_by_rounds(sizes)
    out = []
    for s, docs in by_source.items():
        ratio = target[s] / sizes[s] if sizes[s] else 0.0
        copies, lacking = math.floor(ratio), target[s] - math.floor(ratio) * sizes[s]
        words = Counter()
        for _, n in docs:
            words[max(1, n.bit_length())] += n
        lo, hi = 0.0, 2.0
        for _ in range(200):  # the scale at which the expected words are the lacking ones
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(w * min(1, mid * c) for c, w in words.items()) < lacking else (lo, mid)
        ranked = []
        for i, n in docs:
            u = (int(hashlib.md5(f"mix:{'null' if i is None else i}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = min(1.0, hi * max(1, n.bit_length()))
            q = 0.0 if p >= 1 else math.inf if p <= 0 else u / (1 - u) / (p / (1 - p))
            ranked.append((q, i, n))
        before = 0
        for _, i, n in sorted(ranked):
            extra = n > 0 and lacking > 1e-9 and before + n / 2 <= lacking
            before += n
            out.append((i, n, sizes[s], (copies + extra) * n))
    return Counter(out), target


def test_awkward_rows(spark):
    rows = awkward(150)
    got = pareto_mix(frame(spark, rows, extra=True)).collect()
    want, target = brute(rows)
    assert Counter((r.doc_id, r.size, r.source_size, r.taken) for r in got) == want
    assert all(r.taken <= 3 * r.size for r in got)
    source = {(r[0], count(r[1])): r[3] for r in rows}
    taken = Counter()
    largest = Counter()
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = pareto_mix(frame(spark, rows[::-1])).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_the_mix_holds_the_copies(spark):
    rows = awkward(150)
    df = frame(spark, rows, extra=True)
    got = mixed(df)
    assert got.columns == df.columns
    words = Counter()
    for r in got.collect():
        words[r.doc_id] += count(r.text)
    assert words == Counter({i: n for i, n in sum_by_id(brute(rows)[0]).items() if n})


def sum_by_id(taken):
    out = Counter()
    for (i, _, _, n), times in taken.items():
        out[i] += n * times
    return out


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pareto_mix(empty).collect() == [] and mixed(empty).collect() == []


def test_many_sources_share_as_one_after_the_other(spark):
    import random

    from scenemill.llm.pareto_mix import source_targets

    rng = random.Random(3)
    sizes = [(f"s{i:03d}" if i else None, rng.choice([0, 1, 5, 50, 5000, 10**6])) for i in range(200)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: 1.0 + i % 3 for i, (name, _) in enumerate(order)}
    total, size, capped = float(sum(n for _, n in sizes)), dict(sizes), set()
    while True:
        level = (total - sum(3.0 * size[c] for c in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in size if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert got == {s: min(3.0 * size[s], level * weight[s]) for s in size}
