"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is named, one of its own on a single machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"


#: The tables of the operator at work, innermost last.
_open: list = []


class Scratch:
    """The intermediate tables that an operator writes, to be removed when its result is written."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Exempts a table that ``materialize`` has returned."""
        self.paths.remove(df._scratch_path)
        self.kept.append(df._scratch_path)
        return df

    def adopt(self, df: DataFrame) -> None:
        """Takes charge of a table that ``materialize`` has returned before."""
        self.paths.append(df._scratch_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that ``materialize`` writes inside are removed at the end, but those that are kept; all are left where the work breaks off."""
    work = Scratch()
    _open.append(work)
    try:
        yield work
    finally:
        _open.remove(work)
    if _open:  # what is kept is for the operator around this one to remove
        _open[-1].paths += work.kept
    for path in work.paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables that are written inside go through Python in batches of so many rows: where a row is a whole text or set, that bounds what a worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._scratch_path = path
    if _open:
        _open[-1].paths.append(path)
    return got


def n_words(text: str = "text"):
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
