import zlib
from collections import Counter

import corpus_pipeline
from scenemill.llm.language_id import LanguageModel
from scenemill.llm.tokens import WORD_BPE, encoder, tokenizer_path

from .cases import SCHEMA, awkward, frame
from .test_pareto_mix import brute as mixed
from .test_pareto_mix import count
from .test_simhash_alike import brute as near


def brute(rows):
    """(doc_id, piece, start, length, crc) of all that the pipeline packs, stage by stage in plain Python."""
    sample = {}
    for r in sorted((r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda r: (r[2], r[0], r[1].encode())):
        sample.setdefault(r[2], []).append(r[1].encode())
    labels, scores = LanguageModel.fit(sample).predict([None if r[1] is None else r[1].encode() for r in rows])
    rows = [r for r, label, score in zip(rows, labels, scores) if label != "und" and score >= 0.5]
    latest = {}
    for r in rows:
        if r[1] not in latest or r[0] > latest[r[1]][0]:
            latest[r[1]] = r
    rows = list(latest.values())
    kept = set(near(rows))
    rows = [r for r in rows if r[0] in kept]
    taken = {(i, n): t for (i, n, _, t), _ in mixed(rows)[0].items()}
    words, out = encoder(tokenizer_path(WORD_BPE)), Counter()
    for r in rows:
        n = count(r[1])
        for _ in range(taken[(r[0], n)] // n if n else 0):
            ids = words.encode([r[1]])[0] + b"\0\0\0\0"
            for k, s in enumerate(range(0, len(ids), 8192)):
                own = ids[s : s + 8192]
                out[(r[0], k, s // 4, len(own) // 4, zlib.crc32(own))] += 1
    return out


def test_run_matches_brute_force(spark, tmp_path):
    rows = awkward(120)
    frame(spark, rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(rows)
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_stages_return_documents(spark):
    docs = frame(spark, awkward(20))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
