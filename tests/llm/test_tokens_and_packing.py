import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scenemill.llm.pattern_packing import Slots, class_patterns, nnls, pack_documents, plan_packing
from scenemill.llm.tokens import BYTE_BPE, WORD_BPE, WordEncoder, encoder, tokenizer_path

from .cases import SCHEMA, awkward, frame

ALPHABET = list("ab Cd E'sréß1 23.,! ?  \n\n\t\r\x0b\x0c\x1c\xa0 'tllΣÉ漢字İ́\x85\0-~ ") + ["<|endoftext|>", "’", "ﬁ", "​"]


@lru_cache
def library(name):
    """A tokenizer of its own, as the file has it."""
    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(alphabet=st.sampled_from([c for c in ALPHABET if len(c) == 1]), max_size=40), st.text(max_size=30)))
def test_ids_are_the_librarys(name, text):
    words = encoder(tokenizer_path(name))
    want = np.array(library(name).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert words.encode([text]) == [want]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_ids_of_many_texts(name):
    rng = random.Random(0)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["it's 's 't don't ''s I'LL  'LL a'll1", " '", ""]
    texts += ["see <|endoftext|> here", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", " <|endoftext|>\n"]
    words, plain = encoder(tokenizer_path(name)), library(name)
    for text, got in zip(texts, words.encode(texts)):
        assert got == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_texts_do_not_go_through_the_library():
    words, asked = WordEncoder(tokenizer_path(BYTE_BPE)), []
    own = words._library
    words._library = lambda text: asked.append(text) or own(text)
    texts = ["Eine Straße.\nDer Weg,\nzwei (12) Tage.", "it-was: 7x\tÉté\nfin\n"]
    assert words.encode(texts) == [np.array(library(BYTE_BPE).encode(t).ids, "<u4").tobytes() for t in texts]
    assert set(asked) == {"\n", "\t"}


@pytest.mark.parametrize("kept", [0, 20, 10**6])
def test_full_memories_change_nothing(kept):
    rng, words = random.Random(1), WordEncoder(tokenizer_path(BYTE_BPE), kept, kept)
    for _ in range(8):
        texts = ["".join(rng.choice([*ALPHABET, "×", "÷", "ÿ", "À", "é.", "ab"]) for _ in range(rng.randrange(40))) for _ in range(60)]
        assert words.encode(texts) == [np.array(library(BYTE_BPE).encode(t).ids, "<u4").tobytes() for t in texts]


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (12, 30)).astype(float), rng.random(12) * 50
    x = nnls(a, b)
    y = np.zeros(30)
    for _ in range(200000):
        y = np.maximum(0, y - a.T @ (a @ y - b) / np.linalg.norm(a, 2) ** 2)
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_patterns_can_fill_a_sequence():
    for p in class_patterns(64, 2048, 32):
        assert sum(32 * (c - 1) + 1 for c in p) <= 2048 <= sum(32 * c for c in p)


@pytest.mark.parametrize("n", [0, 1, 7, 500, 20000])
def test_plans_place_every_piece_once(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(2048, 1 + rng.lognormal(6.0, 1.2, n).astype(int))
    histogram = np.bincount(lengths, minlength=2049)
    plan = plan_packing(histogram)
    placed = Counter()
    for pattern, k in plan.items():
        assert 0 < sum(pattern) <= 2048 and k > 0
        for v in pattern:
            placed[v] += k
    assert placed == Counter(lengths.tolist())
    if n >= 500:
        assert sum(plan.values()) <= 1.01 * lengths.sum() / 2048 + 1
    if n:
        ranks = np.concatenate([np.arange(c) for c in histogram if c])
        sequence, offset = Slots.of(plan).find(np.sort(lengths), ranks)
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == n


def test_small_sequences():
    plan = plan_packing(np.bincount([5, 5, 3, 2, 2, 1, 10], minlength=11), full=10, step=2)
    assert sum(plan.values()) == 3


def test_awkward_rows(spark):
    rows = awkward()
    got = pack_documents(frame(spark, rows, extra=True), with_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = np.array(library(WORD_BPE).encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        for k, s in enumerate(range(0, len(ids), 8192)):
            own = ids[s : s + 8192]
            want[(r[0], k, s // 4, len(own) // 4, zlib.crc32(own), own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []
