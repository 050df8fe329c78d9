"""Helpers shared by the operators: shared-storage tables, checked broadcasts, Arrow maps.

Writing goes through ``DataFrame.checkpoint`` (reliable, shared folder), which also cuts the
lineage: a lost executor replays at most the stage it was in.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robustq.session import ensure_checkpoint_dir

# Parameter: largest table (estimated bytes) that is ever broadcast. Larger ones are joined
# by a shuffle instead; both ways give the same rows.
BROADCAST_BYTES = 48 << 20
# Parameter: text bytes handled at a time inside a Python task (bounds its memory).
CHUNK_BYTES = 1 << 20
# Parameters: rows and bytes of the Arrow batches between the JVM and Python tasks, where the
# session leaves Spark's defaults (10,000 rows, 64 MB a batch, held several times over).
ARROW_ROWS, ARROW_BYTES = 2000, "4m"
_ARROW = (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), str(ARROW_ROWS)),
          ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB"), ARROW_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage once and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared storage, wherever that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: whole texts are large rows."""
    for key, defaults, ours in _ARROW:
        if spark.conf.get(key) in defaults:
            spark.conf.set(key, ours)


def broadcast_if_bounded(df: DataFrame, width: Column | int,
                         limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already saved) marked for broadcast if the sum of ``width`` (bytes of a row)
    is within ``limit``; otherwise ``df`` itself, so that Spark joins by a shuffle."""
    w = width if isinstance(width, Column) else F.lit(width)
    total = df.agg(F.coalesce(F.sum(w), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if total <= limit else df


def join_by_any(df: DataFrame, one: DataFrame, on: Sequence[str], salt: Column, width: int,
                salts: int = 32) -> DataFrame:
    """Join ``df`` with ``one`` (saved, one row per key), whatever share of ``df`` one key holds:
    ``one`` is broadcast within the checked size; beyond it the rows of a key are dealt over
    ``salts`` tasks by ``salt`` and ``one`` is copied to each."""
    small = broadcast_if_bounded(one, width)
    if small is not one:
        return df.join(small, list(on))
    copies = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    return dealt.join(copies, [*on, "__salt"]).drop("__salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row. A lambda body that names a
    column expression directly would have the optimizer inline and re-evaluate it for every
    array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_slices(batches: Iterator[pa.RecordBatch], text: str,
               limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` text bytes (a longer single text is
    a slice of its own; texts are never cut)."""
    for rb in batches:
        n, at = rb.num_rows, 0
        lens = pc.fill_null(pc.binary_length(rb.column(rb.schema.get_field_index(text))), 0)
        lens = lens.to_numpy(zero_copy_only=False)
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + lens[end] <= limit):
                total += int(lens[end])
                end += 1
            yield rb.slice(at, end - at)
            at = end


def release_memory() -> None:
    """Give memory that a Python worker has freed back to the system. Workers stay after a task, and a
    busy executor has more of them than cores."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_texts(df: DataFrame, text: str, carry: Sequence[str], out: Sequence[tuple[str, str]],
              fn: Callable[[pa.Array], list], done: Callable[[], None] | None = None) -> DataFrame:
    """Row-local Arrow map: the ``carry`` columns followed by the columns ``out`` that
    ``fn`` computes from the text column (one value per row). A carried column that has the
    name of a new one is replaced by it. ``done`` is called in the worker when a task ends, to drop
    what ``fn`` keeps."""
    bounded_batches(df.sparkSession)
    names = [n for n, _ in out]
    carry = [c for c in carry if c not in names]
    # a carried text is sent to the task once
    own = text not in carry
    cols = [F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in carry]
    inp = df.select(*cols, *([F.col(f"`{text}`").cast("string").alias("__text")] if own else []))
    source = "__text" if own else text
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}"
                        for f in inp.schema.fields[:len(carry)]] + [f"`{n}` {t}" for n, t in out])
    probe = inp.select(*[F.lit(None).cast(t).alias(n) for n, t in out])
    types = [_arrow_type(f.dataType.simpleString()) for f in probe.schema.fields]

    def run(batches):
        for rb in row_slices(batches, source):
            new = fn(rb.column(rb.schema.get_field_index(source)))
            arrays = [rb.column(i) for i in range(len(carry))]
            arrays += [a if isinstance(a, pa.Array) else pa.array(a, t)
                       for a, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *names])
        if done is not None:
            done()
        release_memory()

    return inp.mapInArrow(run, fields)


def _arrow_type(t: str) -> pa.DataType | None:
    """Arrow type of a simple column; None (the function returns Arrow arrays) otherwise."""
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
              "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return simple.get(t)
