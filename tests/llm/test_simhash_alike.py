import random

import corpus_pipeline
import pytest

from scenemill.llm.simhash_alike import SHINGLE_WORDS, bit_chance, forest, keep_one_of_alike, key_plan, shingle_set, wide_fingerprint

from .cases import SCHEMA, awkward, frame, prose
from .test_simhash import roots


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """The ids that stay: the least of each component."""
    sets = [slow_set(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if likeness(sets[i], sets[j]) >= 0.8]
    found, least = roots(range(len(rows)), pairs), {}
    for i, r in enumerate(rows):
        least[found[i]] = min(r[0], least.get(found[i], r[0]))
    return sorted(set(least.values()))


def planted(seed=5, pairs=40, words=400):
    """Originals and copies of a likeness of 0.8 to 0.95, and some a little below."""
    rng, rows = random.Random(seed), []
    for k in range(pairs):
        text = prose(rng, words)
        want = 0.8 + 0.15 * k / pairs if k % 4 else 0.7
        copy, own = text.split(), slow_set(text)
        while True:
            changed = list(copy)
            changed[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
            if likeness(own, slow_set(" ".join(changed))) < want:
                break
            copy = changed
        rows += [(2 * k, text, "en", "a", 1), (2 * k + 1, " ".join(copy), "en", "a", 1)]
    return rows


def test_forest_connects_all_that_are_alike():
    rng = random.Random(2)
    sets = [shingle_set(r[1].encode(), SHINGLE_WORDS) for r in planted(pairs=10, words=60)]
    sets += [shingle_set(prose(rng, 3).encode()) for _ in range(20)]
    plain = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if likeness(plain[i], plain[j]) >= 0.8]
    assert roots(range(len(sets)), forest(sets)) == roots(range(len(sets)), pairs)


def test_wide_bits_follow_the_definition():
    digests = shingle_set(prose(random.Random(1), 700).encode())
    few = wide_fingerprint(digests[:100])
    assert len(few) == 64 and wide_fingerprint(digests) != few
    import scenemill.llm.simhash_alike as sa

    whole = wide_fingerprint(digests)
    step, many = sa._STEP, sa._FEW
    sa._STEP, sa._FEW = 50, 50
    try:
        assert wide_fingerprint(digests) == whole
    finally:
        sa._STEP, sa._FEW = step, many


def test_copies_differ_in_no_more_bits_than_planned():
    shares = []
    for a, b in zip(*[iter(planted(11, 40, 300))] * 2):
        x, y = (int.from_bytes(wide_fingerprint(shingle_set(r[1].encode())), "big") for r in (a, b))
        if likeness(slow_set(a[1]), slow_set(b[1])) >= 0.8:
            shares.append((x ^ y).bit_count() / 512)
    assert max(shares) < bit_chance(0.8) + 0.06


def test_key_plan_follows_the_number_of_texts():
    assert key_plan(0, 0.8)[0] == key_plan(100, 0.8)[0] == 12
    small, large = key_plan(1 << 16, 0.8), key_plan(1 << 32, 0.8)
    assert small[0] == 17 and large[0] == 33 and small[1] < large[1] < small[1] * 20


def test_stage_links_copies_of_likeness_08_to_095(spark):
    rows = planted()
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, frame(spark, rows), "").collect())
    assert kept == brute(rows)
    assert len(kept) == 50  # the copies at 0.8 or more are gone, the ten below stay


@pytest.mark.parametrize("chunk", [512, 5])
def test_awkward_rows(spark, monkeypatch, chunk):
    import scenemill.llm.simhash_alike as sa

    monkeypatch.setattr(sa.alike_links, "__defaults__", (0.8, chunk))
    rows = awkward() + [(i + 1000, *r) for i, (_, *r) in enumerate(planted(9, 12, 100))]
    kept = keep_one_of_alike(frame(spark, rows, extra=True))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r[0] for r in kept.collect()) == brute(rows)


def test_empty_table(spark):
    assert keep_one_of_alike(spark.createDataFrame([], SCHEMA)).collect() == []
