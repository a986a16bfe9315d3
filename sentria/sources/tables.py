"""Reading of the engine's tables.

A table is one parquet file or a directory of them below a base path. Columns are pruned before
anything else, so that extra columns, whatever their names, never reach an operator.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` below ``base``; the schema comes from the files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def with_columns_only(df: DataFrame, *names: str, distinct: bool = False) -> DataFrame:
    """Only the named columns. A column the table lacks comes out as null string, so an older
    table does not crash an operator; ``distinct`` collapses repeated rows (map-side first)."""
    have = set(df.columns)
    out = df.select(*[df[f"`{n}`"] if n in have else F.lit(None).cast("string").alias(n) for n in names])
    return out.distinct() if distinct else out


def shared_dir(spark: SparkSession) -> str:
    """Directory that all executors share: the session's ``spark.checkpoint.dir``. Only where that
    is unset (a local test session) a local temporary folder is made and set."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sentria-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage, survives the loss
    of executors and is smaller than a checkpoint. Removed when the session's process ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sentria/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(_remove, spark, at)
    return spark.read.schema(df.schema).parquet(at)


def _remove(spark: SparkSession, at: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass
