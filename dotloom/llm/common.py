"""Tables, scratch space and literals that the operators share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors as an archive, once an application, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        archive = Path(tempfile.mkdtemp(prefix="dotloom-")) / "dotloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(PACKAGE.rglob("*.py")):
                z.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the executors get this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master may use a folder of its own; any other master is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, without lineage, safe against lost executors.

    Its shuffle files are dropped as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_memories: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Tell what a Python worker keeps between tasks for an operator, by the function that gives it up."""
    _memories[operator] = forget


def only(operator: str) -> None:
    """Called where an operator's code begins in a worker: what others left behind goes."""
    for name, forget in _memories.items():
        if name != operator:
            forget()
    settle()


def settle() -> None:
    """Give freed memory back to the system: workers idle while later stages run on the same executors."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


#: Bits of the fixed-size filter of ``probably_in``.
FILTER_BITS = 1 << 23


def probably_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose long ``key`` may be among those of ``wanted`` (one column of that name).

    A bitmap of fixed size is broadcast: at most FILTER_BITS / 64 rows, however many keys are wanted.  It lets every
    wanted key pass, so an exact join after it loses nothing; it only spares rows an exchange.
    """
    place = F.xxhash64(F.col(key))
    word = F.floor(F.pmod(place, F.lit(FILTER_BITS)) / 64).cast("int")
    bit = F.pmod(place, F.lit(64)).cast("int")
    at, of = fresh(df, "_word"), fresh(df, "_bits")
    bits = wanted.select(word.alias(at), bit.alias("bit")).groupBy(at).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias(of))
    return df.withColumn(at, word).join(F.broadcast(bits), at).where(F.getbit(of, bit) == 1).drop(at, of)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """Null text is the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
