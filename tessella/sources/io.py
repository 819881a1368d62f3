"""Readers and writers: TSV, CSV, JSON, text reports. Every write goes to a folder beside its place and is then renamed."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """A delimited file with a header, read with an explicit schema; no inference pass."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=True)


def _published(spark: SparkSession, path: str, write) -> str:
    """What `write` puts into a folder, at `path`: readers see the old output, none for a moment, or the whole new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    made, place = hadoop(f"{path}.{uuid.uuid4().hex}"), hadoop(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(made.toString())
        old = hadoop(f"{path}.old-{uuid.uuid4().hex}")
        if files.exists(place):
            files.rename(place, old)
        if not files.rename(made, place):
            files.rename(old, place)
            raise OSError(f"cannot rename {made.toString()} to {path}")
        files.delete(old, True)
    finally:
        files.delete(made, True)
    return path


def write_delimited(df: DataFrame, path: str, sep: str = ",", stamped: bool = False) -> str:
    """Writes with a header. With `stamped`, the time becomes part of the name. Gives the path."""
    if stamped:
        stamp = df.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
        path = f"{path}_{stamp}"
    return _published(df.sparkSession, path, lambda to: df.write.option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(to, sep=sep, header=True))


def write_table(df: DataFrame, path: str) -> str:
    return _published(df.sparkSession, path, lambda to: df.write.parquet(to))


def write_text(df: DataFrame, path: str) -> str:
    """A report (section, key, value) as text lines, in one file."""
    line = F.concat_ws(" | ", "section", "key", F.col("value").cast("string"))
    return _published(df.sparkSession, path, lambda to: df.orderBy("section", "key").coalesce(1).select(line.alias("value")).write.text(to))


def shared(spark: SparkSession) -> str:
    """This session's folder in that of spark.checkpoint.dir, which executors share; a temporary one only for a local session that has
    none. It goes with all settled tables when the driver ends."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-"))
    place = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table, or a folder of them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, for work that reads it many times; cuts the lineage."""
    shared(df.sparkSession)
    return df.checkpoint()


def round_trip(df: DataFrame, sep: str) -> DataFrame:
    """`df` written as delimited text and read again with its own schema."""
    path = write_delimited(df, scratch(df.sparkSession, "delimited"), sep)
    return read_delimited(df.sparkSession, path, df.schema, sep)


def encoding_report(marital_map: dict, education_order: list[str], dummies: list[str], rare: list[str]) -> str:
    """The conversions that cleaning applied, as a JSON object. Its keys."""
    return json.dumps(
        {
            "marital_mapping": marital_map,
            "education_mapping": {"order": education_order, "column": "Education_ord"},
            "marital_status_encoding": {"dummy_columns": dummies, "rare_categories": rare, "grouped_column": "Marital_Status"},
        },
        sort_keys=True,
    )
