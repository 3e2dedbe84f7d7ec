"""Helpers shared by the corpus operators: shared storage, keys, Arrow loops."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_folder(application: str) -> str:
    """A local session's own folder, one for each application."""
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) is a
    temporary folder made, once per session; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docskein/{name}-{uuid.uuid4().hex}"


FILE_ROWS = 250_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start
    from files that outlive any executor, and the work above runs once.

    ``rows``, where a bound on the number of (narrow) rows is known, keeps small
    tables in few files; their number grows with the bound.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for tables in _SCRATCH:
        tables.append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Within it all tables that ``materialize`` writes are noted; at its end they
    are removed, but for those that the caller took out of the list.  For work
    whose result is itself written down inside."""
    tables: list[DataFrame] = []
    _SCRATCH.append(tables)
    try:
        yield tables
    finally:
        _SCRATCH[:] = [t for t in _SCRATCH if t is not tables]
        release(*tables)


def release(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote.  Only for tables on which nothing
    depends that is still to run: all that was made of them is written down."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def whole_text(text: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(*cols: Column) -> tuple[Column, Column]:
    """A 128-bit key of a row's content as two longs.

    It is the same whenever a lost partition is computed again, and rows that
    agree in all ``cols`` (nulls too) share it.
    """
    null_bits = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(*cols, null_bits), F.xxhash64(F.lit(7919), null_bits, *reversed(cols))


def need(df: DataFrame, **columns: str) -> None:
    """Fail early, by name, when an input lacks a column."""
    missing = [c for c in columns.values() if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks {missing}; it has {df.columns}")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or a variant of it that no column in ``taken`` has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into small slices, so that Python holds few whole
    texts at a time however many rows Spark puts into a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordCache(dict):
    """What was made of words seen before.  It is bounded by bytes: ``trim``, called
    before each text, lets a full cache start anew, and a word of over ``longest``
    characters is not kept."""

    def __init__(self, most: int = 192 << 20, longest: int = 200) -> None:
        super().__init__()
        self.most, self.longest, self.held = most, longest, 0

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0

    def add(self, more: dict) -> None:
        for word, value in more.items():
            if len(word) <= self.longest:
                self[word] = value
                self.held += 200 + len(word) + (len(value) if isinstance(value, bytes) else 64)


HOT_KEYS = 250_000


def skewed_join(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``small`` (unique ``keys``; a written table),
    whose column ``weight`` says how many rows have a key.

    Keys with more than 1 / HOT_KEYS of all weight are broadcast: there are
    fewer than HOT_KEYS of them, whatever the data.  Other rows are shuffled to
    their keys, so that none meets more than that share of them in one task.
    ``how`` is inner or left (columns of ``small`` are null where there is none).
    """
    told = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("all")).first()
    fields = [c for c in small.columns if c not in (*keys, weight)]
    own = rows.columns
    packed = lambda df, name: df.select(*keys, F.struct(F.lit(True).alias("_there"), *fields).alias(name))
    if told["n"] <= HOT_KEYS:
        hot, rest = small, None
    else:
        limit = told["all"] / HOT_KEYS
        hot, rest = small.where(F.col(weight) > limit), small.where(F.col(weight) <= limit)
    out = rows.join(F.broadcast(packed(hot, "_hot")), keys, "left" if rest is not None else how)
    if rest is None:
        return out.select(*own, *[F.col("_hot").getField(c).alias(c) for c in fields])
    met = out.where("_hot IS NOT NULL").select(*own, *[F.col("_hot").getField(c).alias(c) for c in fields])
    others = out.where("_hot IS NULL").select(*own).join(packed(rest, "_rest"), keys, how).select(*own, *[F.col("_rest").getField(c).alias(c) for c in fields])
    return met.unionByName(others)
