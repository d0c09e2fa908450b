import math
import random
import zlib

import numpy as np
import pytest

from scenemill.llm.language_id import ORDER, LanguageModel, _fold, identify_languages, keep_identified, training_sample

from .cases import SCHEMA, awkward, frame

EN = ["the quick brown fox jumps over the lazy dog", "nothing that we know of was there before the house was built"]
DE = ["der schnelle braune fuchs springt über den faulen hund", "nichts was wir kennen war dort bevor das haus gebaut wurde"]


def slow_cost(samples, data, i):
    """Bits of byte i of ``data`` by the definition, from counts in a dict."""
    counts = {}
    for text in samples:
        for j in range(ORDER, len(text)):
            for k in range(ORDER + 1):
                counts.setdefault(text[j - k : j], {}).setdefault(text[j], 0)
                counts[text[j - k : j]][text[j]] += 1
    bits = 0.0
    for k in range(ORDER, -1, -1):
        seen = counts.get(data[i - k : i])
        if seen is None:
            continue
        total = sum(seen.values()) + len(seen)
        if data[i] in seen:
            return bits - math.log2(seen[data[i]] / total)
        bits -= math.log2(len(seen) / total)
    return bits + 8


def test_costs_match_the_definition():
    samples = {"en": [t.encode() for t in EN], "de": [t.encode() for t in DE]}
    model = LanguageModel.fit(samples)
    rng = random.Random(1)
    text = "ein fox was über zzz Qq" + "".join(rng.choice("abc üß") for _ in range(60))
    data = _fold(text.encode())
    got = model.byte_costs(np.frombuffer(data, np.uint8))
    for g, lang in enumerate(model.languages):
        folded = [_fold(t) for t in samples[lang]]
        # the fitted stream is the concatenation of the folded texts
        want = [slow_cost([b"".join(folded)], data, i) for i in range(ORDER, len(data))]
        assert got[:, g] == pytest.approx(want, rel=1e-5)


def test_long_texts_are_scored_whole():
    model = LanguageModel.fit({"en": [t.encode() for t in EN], "de": [t.encode() for t in DE]})
    text = (" ".join(EN) + " ").encode() * 20000
    one = model.code_lengths([text])[0]
    data = np.frombuffer(_fold(text), np.uint8)
    assert one == pytest.approx(model.byte_costs(data).sum(axis=0, dtype=np.float64), rel=1e-9)


def docs(n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang, words = rng.choice([("en", " ".join(EN).split()), ("de", " ".join(DE).split())])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 60))), lang if i % 7 else None, "a", 1))
    return rows


def test_held_out_accuracy(spark):
    rows = docs()
    truth = {r[0]: "en" if any(w in r[1].split() for w in " ".join(EN).split()) and not any(w in r[1].split() for w in " ".join(DE).split() if w not in EN[0] + EN[1]) else "de" for r in rows}
    got = identify_languages(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_nothing_is_learned_from_held_out_rows(spark):
    rows = [(i, "alpha beta", "en" if zlib.crc32(str(i).encode()) % 3 == 1 else "de", "a", 1) for i in range(30)]
    assert list(training_sample(frame(spark, rows))) == ["de"]


def test_awkward_rows(spark):
    rows = awkward()
    got = identify_languages(frame(spark, rows, extra=True)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by_id = {r.doc_id: r for r in got}
    for i in (200, 201, 202, 208):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    kept = keep_identified(frame(spark, rows, extra=True))
    assert "lang_pred" in kept.columns
    assert not {200, 201, 202, 208} & {r.doc_id for r in kept.collect()}


def test_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert identify_languages(empty).collect() == []
    unlabelled = frame(spark, [(1, "some text", None, None, 9)])
    assert [tuple(r)[2:] for r in identify_languages(unlabelled).collect()] == [("und", 0.0)]


def test_a_corpus_without_labels_is_kept_whole(spark):
    from scenemill.llm.language_id import keep_identified

    rows = [(i, t, None, "a", 1) for i, t in enumerate([None, "", "one two", "12 34"])]
    docs = frame(spark, rows, extra=True)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 4


def test_the_sample_is_bounded_and_the_same_for_any_partitioning(spark):
    from scenemill.llm.language_id import training_sample

    rows = [(i % 7, f"{'x' * 300} {i}", "en", "a", 1) for i in range(900)] + [(3, "again", "de", "a", 1)] * 50
    docs = frame(spark, rows)
    first = training_sample(docs, rows=20, most_bytes=5000)
    assert first == training_sample(docs.repartition(11), rows=20, most_bytes=5000)
    assert all(len(t) <= 40 and sum(map(len, t)) <= 5000 for t in first.values())
