"""Token ids of a corpus in files of patched frame-of-reference blocks, in ascending id order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenemill.llm.common import bounded_batches, materialise, workspace
from scenemill.llm.files import create, new_file, open_file
from scenemill.llm.pfor import Reader, Writer
from scenemill.llm.tokens import BYTE_BPE, encoder, tokenizer_path

_END = b"\0\0\0\0"
_ROWS = 512

#: Words and parts kept by a worker: case and the space before them count here, so there are more of them.
KEPT_WORDS, KEPT_PARTS = 900_000, 800_000

_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _file_writer(folder: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, writer, name = TaskContext.get().partitionId(), encoder(path, KEPT_WORDS, KEPT_PARTS), None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                own = batch.slice(lo, _ROWS)
                if writer is None:
                    name = new_file(folder, part, ".pfor")
                    writer = Writer(create(name))
                texts = [t if t is not None else "" for t in own.column(1).to_pylist()]
                writer.add(own.column(0).to_pylist(), [e + _END for e in words.encode(texts)])
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "n_docs": n_docs, "n_ids": n_ids}], _MANIFEST)

    return write


def write_token_files(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, folder: str | None = None
) -> DataFrame:
    """Write the token files and return their manifest: ``part, path, n_docs, n_ids, first_id``.

    Documents are range-partitioned by id and sorted, nulls first, ties by text; a file holds one
    partition. Each document is its ids (null text: none) and a final id 0. The manifest names the
    files of the tasks that ended well; ``first_id`` counts the ids in the files before.
    """
    bounded_batches(docs.sparkSession)
    folder = folder or workspace(docs.sparkSession, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    written = rows.mapInArrow(_file_writer(folder, tokenizer_path(tokenizer)), "part int, path string, n_docs long, n_ids long")
    manifest = materialise(written, "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with open_file(row["path"]) as file:
                reader = Reader(file)
                sums = reader.checksums()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(reader.doc_ids, mask=reader.nulls.astype(bool)), pa.array(reader.first + row["first_id"]), pa.array(reader.counts), pa.array(sums)
                ],
                ["id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``id, start, n_tokens, ids_crc32``, a task per file."""
    files = max(1, manifest.count())
    return manifest.select("path", "first_id").repartition(files).mapInArrow(
        _documents, "id long, start long, n_tokens long, ids_crc32 long"
    )


def token_output(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """Write a corpus and read it back: ``id_col, start, n_tokens, ids_crc32``, one row per input row.

    Null texts count as empty: their only id is the final 0. Repeated rows are all written; a null id
    sorts first; extra columns are ignored; an empty table writes no file and gives an empty result.
    """
    read = read_token_files(write_token_files(docs, id_col, text_col, tokenizer))
    return read.withColumnRenamed("id", id_col)
