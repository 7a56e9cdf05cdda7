"""What the operators of this subpackage share: intermediate tables, table names, temporary column names."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: By id of the table; the tables themselves, so that no id comes twice.
_written: dict[int, tuple[SparkSession, str, DataFrame]] = {}

#: Settings of a session while a table is written: shuffle files go when the write has ended, not some time later, and
#: Python workers get batches of some MB of text.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

#: Rows of a lookup side that may be broadcast; above it the operators take a shuffled join.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, a folder of our own.

    A temporary folder is used only with a local master; a cluster without the setting uses its warehouse.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            at = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        else:
            at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siftwell_checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage is cut, and lost executors cost nothing.

    batch: rows of a batch for Python workers, where rows are whole blocks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    settings = {**WHILE_WRITING, **({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {})}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (spark, path, out)
    return out


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow, whose worker gives freed memory back at the end of a task: workers stay for later stages."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
            if trim is not None:
                trim(0)

    return wrapped


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more; leaves others alone."""
    for df in tables:
        if id(df) in _written:
            _delete(*_written.pop(id(df))[:2])


@contextmanager
def written() -> Iterator[list[DataFrame]]:
    """The list of the tables that materialize() writes meanwhile and that aren't free()d again; filled at the end."""
    before, out = set(_written), []
    yield out
    out += [df for k, (_, _, df) in _written.items() if k not in before]


def free_unread(tables: list[DataFrame], docs: DataFrame) -> None:
    """Deletes those of tables that docs doesn't read, and takes them from the list."""
    files = docs.inputFiles() if tables else []
    for df in [*tables]:
        name = _written[id(df)][1].rpartition("/")[2] if id(df) in _written else None
        if not any(f"/{name}/" in f for f in files):
            free(df)
            tables.remove(df)


@atexit.register
def _clean() -> None:
    for spark, path, _ in _written.values():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended  # noqa: BLE001
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark compares names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = name
    while out.lower() in taken:
        out += "_"
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def null_safe(c: Column) -> Column:
    """A string key that tells null from every text."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))
