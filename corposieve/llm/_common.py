"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

from corposieve.sources.corpus import bound_batches, spread

#: A side of a join is broadcast only if its staged rows are measured to have no more bytes than this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corposieve-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and any executor can be lost."""
    path = stage_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def unstage(*dfs: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in dfs:
        if df is not None:
            _delete(df.sparkSession, df._staged)


def _width(kind: DataType, c: Column) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        fixed = 8 + sum(8 for _ in getattr(kind.elementType, "fields", [0]))
        return F.coalesce(F.size(c), F.lit(0)) * fixed + 16
    return F.lit(8)


def measured(df: DataFrame) -> int:
    """About how many bytes the rows of ``df``, which should be staged, take when broadcast."""
    widths = [_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields]
    return df.agg(F.sum(sum(widths[1:], widths[0]) + 24)).first()[0] or 0


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for a broadcast if its rows are measured to have at most ``most`` bytes; else as it is, so the join shuffles."""
    return F.broadcast(df) if measured(df) <= most else df


def clear_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; results that are still to be read from it are lost."""
    _delete(spark, f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents that come in fewer splits than there are cores are dealt out."""
    bound_batches(spark)
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found, "doc_id") if name == "documents" else found
