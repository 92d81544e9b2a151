"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words and white space of every contract: ASCII blanks only.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

#: Items of a chunk of scan().
CHUNK = 256
#: Small tables up to this many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or its checkpoint folder. A session with neither gets
    a temporary one if all of it runs in this process (tests); on a cluster that raises, as no executor would see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
            made = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, made, True)
            context.setCheckpointDir(f"file://{made}")
        base = context._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as __) for the actions inside; those of the caller are back afterwards."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str = "cut", codec: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, and lost executors lose nothing. The shuffle
    files of the step are deleted when it has ended. The folder goes when discard() is called, or with the session."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", codec).parquet(path)
    if not _made:
        atexit.register(_clean)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


#: Folders of cut() that are still there. What a query returns may be computed from them at any time, so they last as long as the session.
_made: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _clean() -> None:
    for path, spark in _made.items():
        try:
            if spark.sparkContext._jsc is None:
                return
            _delete(spark, path)
        except Exception:  # the session has ended before the interpreter; its folder is then the caller's to delete
            return


def discard(*cuts: DataFrame) -> None:
    """Deletes the files of what cut() gave, when nothing that is still to be computed reads them."""
    for df in cuts:
        _delete(df.sparkSession, df.cut_path)
        _made.pop(df.cut_path, None)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is known to have few rows; unhinted otherwise. df must be cheap to count."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def slices(batch: pa.RecordBatch, column: str, rows: int = 2_000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (no copies) with at most so many rows and bytes of a text column; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + size, "right"))
        upto = min(max(upto, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker gives back the memory it no longer needs: workers outlive their tasks, and what they
    hold counts beside the stages that follow."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return done


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any names, which it would refuse for some (backticks, dots)."""
    names, plain = df.columns, T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=plain.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(trimmed(renamed), plain).toDF(*schema.names)


def added(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """schema without columns named like the fields, and the fields behind it."""
    names = [n for n, _ in fields]
    return T.StructType([f for f in schema if f.name not in names] + [T.StructField(n, t) for n, t in fields])


def fresh(taken: list[str], *names: str) -> list[str]:
    """names, each with so many underscores in front that no column has it."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n = f"_{n}"
        out.append(n)
    return out


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns added, evaluated once for each row. Plain projections are merged into what refers to them, filters included, and
    costly expressions repeated for each mention; Spark moves nothing across a generator."""
    made = F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, kind: str, step) -> Column:
    """The states after each item. Arrays grow by copying, so they are kept short: CHUNK states, then one entry a chunk."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))
    none = F.array().cast(f"array<{kind}>")

    def inner(state: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(state.alias("s"), none.alias("out")), lambda b, x: let(step(b["s"], x), lambda n: F.struct(n.alias("s"), F.concat(b["out"], F.array(n)).alias("out"))))

    def outer(a: Column, chunk: Column) -> Column:
        return let(inner(a["s"], chunk), lambda done: F.struct(done["s"].alias("s"), F.concat(a["out"], F.array(done["out"])).alias("out")))

    start = F.struct(zero.cast(kind).alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(chunks, start, outer, lambda a: a["out"]))).otherwise(none)
