"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and all runs on one machine (tests) a temporary folder is made and set for
    the context; on a cluster it is an error.
    """
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sift-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimate(df: DataFrame) -> int:
    """Catalyst's size estimate in bytes; of a plain scan the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, least: int = 400_000, most: int = 64 << 20) -> DataFrame:
    """A table of a few small files over all cores; a row group is read by one task, however many cores are idle.

    Only tables of ``least`` to ``most`` bytes in fewer files than half the
    cores are shuffled once; larger ones come in enough parts by themselves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if least < estimate(df) < most and 2 * len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def is_small(df: DataFrame, limit: int = 8 << 20) -> bool:
    """Whether Catalyst's size estimate of ``df`` is at most ``limit`` bytes.

    File sizes are known before anything runs, so this costs no job; estimates
    of joins grow multiplicatively, i.e. it errs towards ``False``.
    """
    return estimate(df) <= limit


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context; nothing to do where PYTHONPATH already names it."""
    import os
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_sift_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="sift-code-")) / "siftspark.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "siftspark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._sift_shipped = True
