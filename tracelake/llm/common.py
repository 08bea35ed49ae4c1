"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The white space that the contracts name: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Settings for rows that are whole texts, where the session has none of its own: rows that a scan decodes at a time, and
#: rows and bytes that go to a Python worker at a time. Spark's defaults suit short rows; here they would be 50 MB and more.
TEXT_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "64", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def for_texts(spark: SparkSession) -> None:
    for key, value in TEXT_ROWS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, whatever store the path names."""
    for_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one of a local session; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Narrow rows of a stored table in one file, about.
FILE_ROWS = 200_000


#: Bytes of a row group of a stored table: what a writer holds.
ROW_GROUP = 16 << 20


def stored(df: DataFrame, tag: str, rows: int | None = None, busy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows``, for narrow rows, is how many there are or may be: they go to as many files as that takes and no more, since
    small files by the hundred cost more than what is in them. As many tasks make them; ``busy`` says that these have
    work to do besides, so that there are two for each core at least.
    The files are deleted when :func:`discard` or :func:`sweep` says so, or when the application ends.
    """
    spark = df.sparkSession
    for_texts(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(-(-rows // FILE_ROWS), 2 * spark.sparkContext.defaultParallelism if busy else 1))
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    done = spark.read.schema(df.schema).parquet(path)
    done.stored_at = path
    _STORED.append(path)
    return done


#: Stored tables that are still there, the oldest first.
_STORED: list[str] = []


def _delete(spark: SparkSession, paths: list[str], shuffles: bool = True) -> None:
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        _STORED.remove(path)
    if shuffles:  # their files go when the driver's handles on them do
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete stored tables that nothing reads any more, and the shuffle files of what is done."""
    found = [t.stored_at for t in tables if getattr(t, "stored_at", None) in _STORED]
    if found:
        _delete(tables[0].sparkSession, found, shuffles)


def mark() -> list[str]:
    """The stored tables as they are now, for :func:`sweep`."""
    return list(_STORED)


def sweep(spark: SparkSession, since: list[str], keep: list[str]) -> None:
    """Delete the tables stored after the mark ``since``, but for those in ``keep``."""
    if found := [p for p in _STORED if p not in since and p not in keep]:
        _delete(spark, found)


#: Narrow rows (a few numbers each) that are sent to all executors instead of dealing out the other side by key.
SMALL = 1 << 20


def sent_if_small(narrow: DataFrame, rows: int | None = None) -> DataFrame:
    """``narrow``, marked to be broadcast if it has at most SMALL rows (some 50 MB); ``rows`` is their number where it is known."""
    return F.broadcast(narrow) if (narrow.count() if rows is None else rows) <= SMALL else narrow


def ascii_lower(col):
    """A-Z to a-z and nothing else. ``lower`` folds all of Unicode, but agrees on texts without other letters."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


#: A key is hot that holds one in HOT of all rows, or more, and at least HOT_ROWS rows. So at most HOT keys are hot, and fewer than rows / HOT_ROWS.
HOT, HOT_ROWS = 100_000, 1000


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and in ``count`` how many of ``total`` rows hold it.

    Hot keys, whose number is bounded, are sent to the rows, so theirs are never dealt out by key; the rest is
    joined as usual, none of its keys having more than a hundred-thousandth of all rows, or HOT_ROWS.
    """
    is_hot = (F.col(count) * HOT >= total) & (F.col(count) >= HOT_ROWS)
    hot, cold = table.where(is_hot).drop(count), table.where(~is_hot).drop(count)
    few = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return few.unionByName(rest)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: What a Python worker keeps between tasks: one model at a time, whichever operator's.
_KEPT: dict = {}


def kept(key, make: Callable):
    """The worker's model for ``key``, made when it isn't there; that of another operator goes first."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release(key=None) -> None:
    """Give memory back to the machine: workers outlive their tasks, and the next stage needs it. What ``key`` names stays."""
    for other in [k for k in _KEPT if k != key]:
        del _KEPT[other]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable, key=None) -> Callable:
    """``run``, a function of Arrow batches, that leaves no memory behind but the model that ``key`` names."""

    def tidied(batches):
        release(key)
        try:
            yield from run(batches)
        finally:
            release(key)

    return tidied


#: Rows that are Python values at one time.
ROWS = 200


def annotate(df: DataFrame, inputs: list, made: list[tuple[str, T.DataType]], values, keep=None, drop=(), key=None) -> DataFrame:
    """``df`` with the columns ``made``, which ``values`` computes batch by batch in Python.

    ``values`` gets a list of Python values for each of ``inputs`` (columns or their names) and returns a
    list for each of ``made``. ``keep``, an index into ``made``, names a boolean by which rows are filtered;
    it is not returned. All columns of ``df`` pass but those of ``drop``, whatever their names; one of a made
    name is replaced. ``key`` names the model that the worker keeps.
    """
    for_texts(df.sparkSession)
    new = {name for k, (name, _) in enumerate(made) if k != keep} | set(drop)
    rest = [f for f in df.schema.fields if f.name not in new]
    n, m = len(rest), len(inputs)
    source = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)], *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"i{k}") for k, c in enumerate(inputs)])
    shown = [(k, x) for k, x in enumerate(made) if k != keep]
    kinds = to_arrow_schema(T.StructType([T.StructField(*x) for x in made]))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)] + [T.StructField(f"m{k}", x[1]) for k, x in shown])

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            found = values(*[batch.column(n + k).to_pylist() for k in range(m)])
            columns = [*batch.columns[:n], *[pa.array(found[k], kinds.field(k).type) for k, _ in shown]]
            names = [f"c{i}" for i in range(n)] + [f"m{k}" for k, _ in shown]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out if keep is None else out.filter(pa.array(found[keep], pa.bool_()))

    back = source.mapInArrow(tidy(run, key), schema)
    return back.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(rest)], *[F.col(f"m{k}").alias(x[0]) for k, x in shown])
