"""Other sources and sinks: JSON maps, nested stays, listings, incremental and resumable output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stayline.operators.common import written


def read_json_map(spark: SparkSession, path: str | list[str], value: str, key: str = "key") -> DataFrame:
    """JSON files that each hold one map, as rows ``key`` and the fields of ``value`` (a schema string), with ``file``.

    Files may be gzipped; one file is one record, so keep them to the size of a task. A broken file gives no rows.
    """
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{value}>>").alias("m"), F.input_file_name().alias("file"))
    return text.where("m IS NOT NULL").select(F.explode("m").alias(key, "v"), "file").select(key, "v.*", "file")


def merge_maps(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key; of several the last in ``order``."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("t"))
    return g.select(key, *[F.col("t")[c].alias(c) for c in rest])


def write_stays(df: DataFrame, path: str, key: str, buckets: int = 256, mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """Nested stays as parquet in hash buckets of the key, so that one stay is found in one folder.

    A bucket is written by as many tasks as its rows need, a stay always by one.
    """
    h = F.xxhash64(key)
    files = max(1, -(-df.count() // (buckets * rows_per_file)))
    d = df.withColumn("bucket", F.pmod(h, F.lit(buckets)).cast("int")).withColumn("__file", F.pmod(F.floor(h / buckets), F.lit(files)))
    d.repartition(buckets * files, "bucket", "__file").drop("__file").sortWithinPartitions("bucket", key).write.mode(mode).partitionBy("bucket").parquet(path)


def read_stay(spark: SparkSession, path: str, key: str, value: str, buckets: int = 256, schema: StructType | None = None) -> DataFrame:
    """The rows of one stay: only its bucket's files are read. With the ``schema`` that was written a folder without rows can be read too."""
    b = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets)).cast("int").alias("b")).first().b
    read = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])) if schema else spark.read
    return read.parquet(path).where((F.col("bucket") == b) & (F.col(key) == value)).drop("bucket")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("compression", "gzip").csv(path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, nulls left out."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.mode(mode).option("compression", "gzip").text(path)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder as rows ``path, name, modified, bytes``; their contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def not_yet_done(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys aren't in the output yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there and has a file with rows to read, as told by the file system that the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(p))


def resume(spark: SparkSession, todo: DataFrame, keys: Sequence[str], path: str, work: Callable[[DataFrame], DataFrame], batches: int = 8) -> DataFrame:
    """Work off rows in hash batches, each appended to ``path`` when it is done; a second call goes on where the first stopped.

    A batch is the unit of loss: what was appended is never done again. The rows still to be done are found, and written by batch, once.
    """
    left = not_yet_done(todo, spark.read.parquet(path), keys) if exists(spark, path) else todo
    parts, drop = written(left.withColumn("__batch", F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int")), by=["__batch"])
    for k in range(batches):
        work(parts.where(F.col("__batch") == k).select(*todo.columns)).write.mode("append").parquet(path)
    drop()
    return spark.read.parquet(path)


def read_config(path: str) -> dict:
    """A YAML (or, without a YAML library, JSON) configuration, read on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        try:
            return json.loads(text)
        except ValueError:
            from stayline.functions.nested import parse_nested

            return parse_nested(text)
    return yaml.safe_load(text)
