"""Materialising an intermediate table where every executor can read it back."""

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local session
    is given a temporary folder under that name; any other session must set it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="clearwell-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str, with_path: bool = False):
    """Write once, read back columnar: cuts the lineage and survives lost executors.
    ``with_path`` also returns where, for ``drop_table``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return (back, path) if with_path else back


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` for several readings: written once if its plan shuffles, which every reading
    would do again; else as it is."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df, label) if "Exchange" in plan else df


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table written under a path of ``fresh_path``; only those."""
    if path in _written:
        _written.remove(path)
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside the block are removed at its end, but for those whose path is given to
    the function that the block gets; consume results before."""
    before, stay = set(_written), set()
    try:
        yield stay.add
    finally:
        for path in [p for p in _written if p not in before and p not in stay]:
            drop_table(spark, path)
