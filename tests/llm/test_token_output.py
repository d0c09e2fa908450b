import io
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st

from scenemill.llm.files import open_file
from scenemill.llm.pfor import BLOCK, Reader, Writer, decode_blocks, encode_blocks
from scenemill.llm.token_output import token_output, write_token_files
from scenemill.llm.tokens import BYTE_BPE, tokenizer_path

from .cases import SCHEMA, awkward, frame


class Held(io.BytesIO):
    def close(self):
        pass

    def size(self):
        return len(self.getvalue())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3 * BLOCK))
def test_blocks_round_trip(ids):
    blocks = encode_blocks(np.array(ids, np.uint32))
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert decode_blocks(b"".join(blocks), starts.astype(np.int64))[: len(ids)].tolist() == ids if ids else not blocks


@pytest.mark.parametrize("make", [lambda r, n: r.integers(0, 50257, n), lambda r, n: np.zeros(n), lambda r, n: np.where(r.random(n) < 0.02, 2**32 - 1, 5)])
def test_files_round_trip(make):
    rng, file, docs = np.random.default_rng(0), Held(), []
    writer = Writer(file)
    for _ in range(20):
        some = [make(rng, int(rng.integers(0, 2000))).astype("<u4") for _ in range(10)]
        docs += some
        writer.add([None, *range(9)], [d.tobytes() for d in some])
    assert writer.close() == (200, sum(map(len, docs)))
    reader = Reader(file)
    assert all((reader.document(k) == d).all() for k, d in enumerate(docs))
    assert reader.checksums().tolist() == [zlib.crc32(d.tobytes()) for d in docs]
    assert reader.ids(1000, 5).tolist() == np.concatenate(docs)[1000:1005].tolist()
    assert reader.nulls.sum() == 20


def test_damage_is_noticed():
    file = Held()
    writer = Writer(file)
    writer.add([1], [b"\1\0\0\0" * 10])
    writer.close()
    data = bytearray(file.getvalue())
    data[-40] ^= 255
    with pytest.raises(ValueError):
        Reader(Held(bytes(data)))


def brute(rows):
    words = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    out, start = [], 0
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0], x[1] is not None, x[1] or "")):
        ids = np.array(words.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return Counter(out)


def test_awkward_rows(spark):
    rows = awkward()
    got = token_output(frame(spark, rows, extra=True))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_files_are_in_ascending_order(spark):
    manifest = write_token_files(frame(spark, awkward())).orderBy("part").collect()
    ids, at = [], 0
    for r in manifest:
        assert r.first_id == at
        at += r.n_ids
        with open_file(r.path) as file:
            ids += Reader(file).doc_ids.tolist()
    assert ids == sorted(ids) and len(ids) == len(awkward())


def test_empty_table(spark):
    assert token_output(spark.createDataFrame([], SCHEMA)).collect() == []
