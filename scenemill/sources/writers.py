"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, split: str, by: list[str] | None = None) -> None:
    """One Parquet table per split; a table that exists is never written over."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/split={split}")


def write_csv(df: DataFrame, path: str, columns: list[str], digits: int = 4) -> None:
    """A small result as one CSV, columns in order, doubles rounded half to even."""
    kinds = dict(df.dtypes)
    out = [F.bround(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    df.select(*out).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """More lines for an append-only log."""
    df.write.mode("append").json(path)


def write_texts(df: DataFrame, path: str, column: str) -> None:
    """Documents that are text already, such as XML, a line each with its line ends escaped."""
    df.select(F.regexp_replace(column, r"\r?\n", "&#10;").alias("value")).write.mode("errorifexists").text(path)
