"""Session helpers: tables, checkpoints and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application."""
    ctx = spark.sparkContext
    if ctx.applicationId in _SHIPPED:
        return
    _SHIPPED.add(ctx.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cinderbase-code-"), "cinderbase_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    ctx.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset (tests, a single
    machine) a temporary folder is made and set.
    """
    ctx = spark.sparkContext
    named = ctx.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = ctx._jsc.sc().getCheckpointDir()
    if named is None:
        if current.isDefined():
            return current.get()
        if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cinderbase-")
    if not current.isDefined():
        ctx.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lean(df: DataFrame) -> DataFrame:
    """As ``cut``; the shuffles behind the checkpoint are dropped at once, else they stay until the driver happens to collect its garbage."""
    out = cut(df)
    plan, ctx = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext._jsc.sc()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and ctx.cleaner().isDefined():
        for shuffle in list(plan.context().shuffleIds().keySet()):
            ctx.cleaner().get().doCleanupShuffle(shuffle, True)
    return out


_SCRATCH: dict[str, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a written table; it stays until ``clear_scratch``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_TABLES: dict[str, list[str]] = {}


def new_table(spark: SparkSession, label: str) -> str:
    """A fresh name of a catalog table whose files are in the shared folder; it stays until ``clear_scratch``."""
    name = f"cinderbase_{label}_{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    known = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    if path not in known:
        known.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the written tables of this application; call it when their results have been consumed."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = hadoop(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def small_enough(rows: int, bytes_per_row: int, limit: int = 64 << 20) -> bool:
    """Whether a side of a join may be broadcast: its checked size is below the limit."""
    return rows * bytes_per_row <= limit
