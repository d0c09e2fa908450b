"""What the corpus operators share: the shared folder, written intermediate tables, and row filters by key."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys are broadcast only if a count of them is at most this (about 100 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 100_000

#: Rows of text that pass between the JVM and Python at once.
BATCH_ROWS = 1000

#: The ASCII white space that the word operators split on.
SPACES = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session may go without one; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="scenemill-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` rows: a batch holds whole texts, however long they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def workspace(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/scenemill/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(hadoop)
    # With its scheme, so that files written by Python go where Spark's do.
    return system.makeQualified(hadoop).toString()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key(name: str) -> Column:
    """Tells apart rows that share an id: SHA-256 of the text (null as empty)."""
    return F.sha2(text_of(name), 256)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if a count of it allows that."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _keys(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """Distinct (id, text digest) pairs of ``rows`` under names that ``docs`` does not have, and the condition that finds them."""
    id_name, key_name = fresh(docs, "__id", "__key")
    keys = rows.select(F.col("id").alias(id_name), F.col("row_key").alias(key_name)).distinct()
    return keys, F.col(id_col).eqNullSafe(F.col(id_name)) & (row_key(text_col) == F.col(key_name))


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose (id, text digest) is in ``dropped`` (columns ``id``, ``row_key``).

    The keys are counted first: few are broadcast, many are joined by a shuffle.
    """
    keys, on = _keys(docs, dropped, id_col, text_col)
    return docs.join(broadcast_if_small(materialise(keys, "dropped")), on, "left_anti")


def one_of_repeated(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows equal in id and text, keep one; ``repeated`` lists the (id, row_key) pairs that occur more than once."""
    if repeated.isEmpty():
        return docs
    rest = without(docs, repeated, id_col, text_col)
    again, on = _keys(docs, repeated, id_col, text_col)
    (key,) = fresh(docs, "__key")
    some = docs.join(again, on, "left_semi").withColumn(key, row_key(text_col))
    return rest.unionByName(some.dropDuplicates([id_col, key]).drop(key))
