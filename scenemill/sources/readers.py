"""Scans. Missing numbers come in as NULL, never as NaN; schemas are given, not inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemill.functions.scalar import no_nan


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in float and double columns read as null."""
    return df.withColumns({f.name: no_nan(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)})


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return without_nan(df.select(*columns) if columns else df)


def read_json_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table kept as one JSON array of records."""
    return without_nan(spark.read.schema(schema).json(path, multiLine=True))


def read_json_tables(spark: SparkSession, folder: str, schemas: dict[str, str], columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Tables of a folder of ``<name>.json`` by name; with ``columns`` only the tables it names, and of these only its columns."""
    wanted = columns or dict.fromkeys(schemas)
    frames = {name: read_json_table(spark, f"{folder}/{name}.json", schemas[name]) for name in wanted}
    return {name: df.select(*wanted[name]) if wanted[name] else df for name, df in frames.items()}


def first_that_exists(spark: SparkSession, stem: str, suffixes: tuple[str, ...] = (".jsonl", ".txt")) -> str:
    """The stem with the first suffix under which there is a file, in whatever file system it names."""
    for suffix in suffixes:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stem + suffix)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return stem + suffix
    raise FileNotFoundError(f"{stem} with none of {', '.join(suffixes)}")


def read_results(spark: SparkSession, stem: str, schema: str, error: str | None = "backend_error") -> DataFrame:
    """Results kept as ``<stem>.jsonl``, or as ``<stem>.txt`` where there is no such file."""
    return read_log(spark, first_that_exists(spark, stem), schema, error)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return without_nan(spark.read.schema(schema).csv(path, header=True))


def read_log(spark: SparkSession, paths: str | list[str], schema: str, error: str | None = "backend_error") -> DataFrame:
    """An append-only JSON-lines log: torn and blank lines, rows without their first field and rows with a backend error are left out."""
    rows = spark.read.schema(f"{schema}, __torn string").json(paths, columnNameOfCorruptRecord="__torn", mode="PERMISSIVE")
    rows = rows.where(F.col("__torn").isNull() & F.col(rows.columns[0]).isNotNull()).drop("__torn")
    return rows.where(~F.coalesce(F.col(error), F.lit(False))) if error and error in rows.columns else rows


def todo(items: DataFrame, log: DataFrame, token: str) -> DataFrame:
    """Items that the log does not hold yet."""
    return items.join(log.select(token).distinct(), token, "left_anti")


def exploded(documents: DataFrame, column: str) -> DataFrame:
    """A JSON document's list of records as rows."""
    return documents.select(F.explode(column).alias("__r")).select("__r.*")


def chain_order(records: DataFrame, scene: str, time: str, out: str = "k") -> DataFrame:
    """Records of a scene in the order of their linked list, which is that of time."""
    return records.withColumn(out, (F.row_number().over(Window.partitionBy(scene).orderBy(time)) - 1).cast("int"))


def light_positions(lights: DataFrame, nodes: DataFrame, light: str, node_list: str, node: str, height: str) -> DataFrame:
    """Light positions as means of their line's nodes; records without geometry are dropped by the join."""
    each = lights.select(light, height, F.explode(node_list).alias(node))
    return each.join(nodes, node).groupBy(light, height).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def polygon_tokens(records: DataFrame, plural: str, single: str) -> DataFrame:
    """One row per polygon, whichever of the two keys a record has."""
    return records.withColumn("polygon", F.explode(F.coalesce(F.col(plural), F.array(F.col(single))))).where("polygon is not null")


def camera_files(files: DataFrame, prefix: str, keyframe: Column) -> DataFrame:
    return files.where(F.col("filename").startswith(prefix) & keyframe)


def lane_centrelines(arcs: DataFrame, step: float = 1.0) -> DataFrame:
    """Directed centrelines ``line, seq, px, py`` of lanes kept as arc-line paths, a vertex about every ``step`` metres.

    ``arcs(line, part, x, y, theta, radius, shape, lengths)``: each part starts at a pose and has three segments that turn left (L), go
    straight (S) or turn right (R) on the radius. Points are evenly spaced over a part, both ends included; parts that cannot be read
    (nulls, no radius, unknown shapes) are left out.
    """
    length = lambda i: F.get("lengths", F.lit(i))
    ok = F.col("shape").rlike("^[LSR]{3}$") & (F.size("lengths") == 3) & (F.col("radius") > 0) & F.col("theta").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = arcs.where(F.coalesce(ok, F.lit(False))).withColumns({"__x0": F.col("x"), "__y0": F.col("y"), "__h0": F.col("theta"), "__s0": F.lit(0.0)})

    def moved(i: int, along: Column) -> tuple[Column, Column, Column]:
        bend = F.when(F.substr("shape", F.lit(i + 1), F.lit(1)) == "L", 1.0).when(F.substr("shape", F.lit(i + 1), F.lit(1)) == "R", -1.0).otherwise(0.0) / F.col("radius")
        x, y, h = F.col(f"__x{i}"), F.col(f"__y{i}"), F.col(f"__h{i}")
        end = h + bend * along
        across = F.when(bend == 0, along * F.cos(h)).otherwise(F.try_divide(F.sin(end) - F.sin(h), bend))
        up = F.when(bend == 0, along * F.sin(h)).otherwise(F.try_divide(F.cos(h) - F.cos(end), bend))
        return x + across, y + up, end

    for i in range(2):
        x, y, h = moved(i, length(i))
        rows = rows.withColumns({f"__x{i + 1}": x, f"__y{i + 1}": y, f"__h{i + 1}": h, f"__s{i + 1}": F.col(f"__s{i}") + length(i)})
    total = F.col("__s2") + length(2)
    rows = rows.withColumn("__total", total).withColumn("__n", F.greatest(F.lit(2), F.ceil(F.col("__total") / step) + 1).cast("int"))
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumn("__at", F.col("__i") * F.col("__total") / (F.col("__n") - 1))
    place = F.when(F.col("__at") <= F.col("__s1"), 0).when(F.col("__at") <= F.col("__s2"), 1).otherwise(2)
    points = [moved(i, F.col("__at") - F.col(f"__s{i}")) for i in range(3)]
    pick = lambda k: F.when(place == 0, points[0][k]).when(place == 1, points[1][k]).otherwise(points[2][k])
    seq = F.row_number().over(Window.partitionBy("line").orderBy("part", "__i")) - 1
    return rows.select("line", "part", "__i", pick(0).alias("px"), pick(1).alias("py")).withColumn("seq", seq).select("line", "seq", "px", "py")


def bundle_manifest(spark: SparkSession, path: str, members: list[str]) -> DataFrame:
    """Name, length and SHA-256 of the members of a bundle; running it fails if one of them is missing or empty."""
    wanted = spark.createDataFrame([(m,) for m in members], "name string")
    found = wanted.join(file_manifest(spark, path), "name", "left")
    whole = F.when(F.coalesce(F.col("length"), F.lit(0)) > 0, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("missing or empty: "), F.col("name"))).cast("string"))
    return found.select("name", "length", whole.alias("sha256"))


def verify_files(manifest: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Counts of manifest entries that are present, missing or empty; ``files(name, length)``."""
    joined = manifest.join(files.select(name, "length"), name, "left")
    return joined.agg(F.count("*").alias("expected"), F.count("length").alias("present"), F.count_if(F.col("length").isNull()).alias("missing"), F.count_if(F.col("length") == 0).alias("empty"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and SHA-256 of files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
