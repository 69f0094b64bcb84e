"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A stage that is read more than once, or that ends a long lineage, is written as Parquet there, so
that a lost executor costs no recomputation and every executor can read it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with more than this part of the rows is joined by broadcast: fewer than ``HOT_GROUPS`` groups can be so large.
HOT_GROUPS = 10_000
#: A group of no more rows than this is no burden to a task, whatever its part.
HOT_ROWS = 5_000

_LOCAL: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session may go without one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="groundtrace-"))
        atexit.register(_remove, _LOCAL[0])
    return f"file://{_LOCAL[0]}"


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet, with the writer's options, and read back: its lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for file in df.inputFiles()[:1]:
            path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def attached(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their group, without those that have none. ``groups``: (keys, ``n`` rows of each, ...).

    Both are written tables. The largest groups are joined by broadcast, so that none of them is dealt to one task; the driver
    holds a hash of each of these, of fewer than ``HOT_GROUPS`` in all.
    """
    known = F.xxhash64(*keys)
    hot = [r[0] for r in groups.filter(F.col("n") > max(rows.count() // HOT_GROUPS, HOT_ROWS)).select(known).collect()]
    if not hot:
        return rows.join(groups.hint("merge"), keys).drop("n")
    rest = rows.filter(~known.isin(hot)).join(groups.filter(~known.isin(hot)).hint("merge"), keys)
    return rows.filter(known.isin(hot)).join(F.broadcast(groups.filter(known.isin(hot))), keys).unionByName(rest).drop("n")
