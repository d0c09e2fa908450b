"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator on all that its predecessor kept and returns the columns of ``documents``;
the last returns the packed pieces. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenemill.llm.common import materialise
from scenemill.llm.exact_dedup import keep_distinct
from scenemill.llm.language_id import keep_identified
from scenemill.llm.pareto_mix import mixed
from scenemill.llm.pattern_packing import pack_documents
from scenemill.llm.simhash_alike import keep_one_of_alike

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: null or letterless texts, and near ties of two languages.

    A corpus without a label teaches no language, so nothing can be rejected: all rows stay. A null lang is no
    label; nulls in other columns do not matter; texts of any length are read whole; repeated rows are
    judged alike; an empty table stays empty; columns other than those of ``documents`` are left out.
    """
    return keep_identified(docs.select(*COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest id.

    A null text equals an empty one; a null id is the smallest; of rows that repeat id and text one stays. Texts
    of any length are compared whole; an empty table stays empty; columns other than those of ``documents`` are left out.
    """
    return keep_distinct(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in 0.8 or more of their 5-word shingles keep the row with the least id.

    Texts without words are alike, a text of fewer words is one shingle; ties of ids go to the lesser text
    digest, a null id stays only where there is no other; rows repeated whole are one. Texts of any length
    count whole; an empty table stays empty; columns other than those of ``documents`` are left out.
    """
    return keep_one_of_alike(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the sources to their target weights; a document comes as often as it was drawn.

    A null source is one of its own; texts without words are never drawn; ties of the draw go by id and size;
    rows repeated whole are drawn one by one. Texts of any length count whole; an empty table stays empty;
    columns other than those of ``documents`` are left out.
    """
    return mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences, one row per piece (``pack_documents``).

    A null text is empty and still takes its end id; null ids and repeated rows are packed each; long texts are
    cut into pieces; pieces of a length are interchangeable, so ties need no rule; an empty table gives no
    piece; columns other than id and text are left out.
    """
    return pack_documents(docs.select(*COLUMNS))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("source mix", mix), ("packing", pack)]

#: Fingerprints, byte contexts and token ids are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
