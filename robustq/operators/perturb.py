"""Perturbations (D): build prompt variants from any DataFrame with a token-array column.

The same operator perturbs a tiny trigger table (one row per seed) or every row of an
example table; all draws are md5 ranks keyed by ``key`` columns, so results do not depend
on partitioning. Every operator is row-local, without a shuffle: an expression (explode +
higher-order functions) or, where a row takes hundreds of draws, a function over Arrow batches
(:mod:`robustq.functions.digests`).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from robustq.functions.bind import bind
from robustq.functions.digests import drawn_orders, numbered_orders, same_shape
from robustq.functions.text import words

# fixed values
DELETE_SIZES = (3, 5, 7)
DELETE_REPS = 10
REORDER_REPS = 10
_BLOCK = 1 << 16  # permutation numbers per exploded array
_PART = 1 << 17    # tokens whose copies are made at once
_REP, _N_DEL = T.StructField("rep", T.IntegerType()), T.StructField("n_del", T.IntegerType())
_DEL_IDX = T.StructField("del_idx", T.StringType())
_TABLE_LEN = 4    # up to this length the permutations come from a literal table


def positions(c: str | Column) -> Column:
    """0-based positions of an array (empty for an empty array)."""
    a = F.col(c) if isinstance(c, str) else c
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)) \
        .otherwise(F.array().cast("array<int>"))


def _key_text(key: Sequence[str]) -> Column:
    """What every message of a row's draws starts with: its key, each part followed by ':'."""
    return F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(""))


def _list_offsets(sizes: Sequence[int], rows: int) -> np.ndarray:
    """Offsets of the lists of ``rows`` rows, each with one list of every size in turn."""
    return np.concatenate([[0], np.cumsum(np.tile(np.asarray(sizes, np.int64), rows))]).astype(np.int32)


def _with_orders(df: DataFrame, col: str, key: Sequence[str], new: Sequence[T.StructField],
                 make: Callable[[np.ndarray, int], tuple]) -> DataFrame:
    """Several rows per row of ``df``, made in Arrow batches.

    ``make(prefix, n)`` gets the key texts (a byte matrix) of rows with ``n`` tokens each and returns
    (positions kept by each copy (its length), positions kept (row, copy after copy), columns ``new``
    (name to array)); the token array of a copy becomes the tokens at its positions. ``new`` are the
    fields after the columns of ``df``; their values are flat, copy after copy of each row. All copies
    of a row leave together: written to a file, they are packed against each other."""
    names = [x.name for x in new]
    inp = df.drop(*names).select("*", _key_text(key).alias("__key"), F.coalesce(F.size(col), F.lit(0)).alias("__n"))
    carry = inp.columns[:-2]
    at, width = carry.index(col), len(carry)
    schema = T.StructType([*inp.schema.fields[:width], *new])

    def part(rb: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key_texts = [x.encode() for x in rb.column(width).to_pylist()]
        sizes = np.maximum(np.asarray(rb.column(width + 1)), 0).astype(np.int64)
        tokens = rb.column(at)
        offsets, missing = np.asarray(tokens.offsets), np.asarray(tokens.is_null())
        for rows, prefix, n in same_shape(key_texts, sizes):
            sizes_kept, kept, values = make(prefix, n)
            many = np.repeat(rows, len(sizes_kept))
            places = (offsets[rows].astype(np.int64)[:, None] + kept).reshape(-1)
            lists = pa.ListArray.from_arrays(
                _list_offsets(sizes_kept, len(rows)), tokens.values.take(pa.array(places)),
                mask=None if values.get("_empty") else pa.array(missing[many]))
            carried = [lists if i == at else c.take(pa.array(many)) for i, c in enumerate(rb.columns[:width])]
            yield pa.RecordBatch.from_arrays([*carried, *[values[x] for x in names]], names=[*carry, *names])

    def run(batches):
        for rb in batches:
            # a few thousand rows or long arrays at a time: what is held does not grow with the texts
            cost = np.cumsum(np.maximum(np.asarray(rb.column(width + 1)), 1).astype(np.int64)) // _PART
            for rows in np.split(np.arange(rb.num_rows), np.flatnonzero(np.diff(cost)) + 1):
                if len(rows):
                    yield from part(rb.slice(int(rows[0]), len(rows)))

    return inp.mapInArrow(run, schema)


def delete_each(df: DataFrame, col: str = "tokens") -> DataFrame:
    """D3: one variant per position with that token removed (the only token of a row leaves
    an empty variant)."""
    d = df.withColumn("_del", F.explode(positions(col)))
    return (d.withColumn(col, F.filter(F.col(col), lambda t, i: i != F.col("_del")))
            .withColumn("del_idx", F.col("_del").cast("string"))
            .withColumn("n_del", F.lit(1))
            .drop("_del"))


def delete_random(df: DataFrame, col: str = "tokens", key: Sequence[str] = ("seed",),
                  ns: Sequence[int] = DELETE_SIZES, reps: int = DELETE_REPS) -> DataFrame:
    """``reps`` x ``ns`` variants, each deleting n distinct random positions; del_idx
    lists the positions in draw order joined by '-'. A size n >= len(tokens) deletes all
    tokens: the variant is empty and n_del says how many were there."""
    def make(prefix: np.ndarray, n: int):
        places = pa.array([str(p) for p in range(n)], pa.string())
        rows, gone_sizes = len(prefix), []
        drawn, kept = [np.empty((rows, 0), np.int32)], [np.empty((rows, 0), np.int64)]
        for size in ns:
            some = drawn_orders(prefix, n, [f"{rep}:{size}" for rep in range(reps)])[..., :size]
            k = some.shape[2]
            gone = np.zeros((rows * reps, n), bool)
            np.put_along_axis(gone, some.reshape(rows * reps, k), True, 1)
            gone_sizes += [k] * reps
            drawn.append(some.reshape(rows, reps * k))
            kept.append(np.nonzero(~gone)[1].reshape(rows, reps * (n - k)))
        idx = pc.binary_join(pa.ListArray.from_arrays(
            _list_offsets(gone_sizes, rows), places.take(pa.array(np.concatenate(drawn, axis=1).reshape(-1)))), "-")
        return [n - k for k in gone_sizes], np.concatenate(kept, axis=1), {
            "rep": pa.array(np.tile(np.arange(reps, dtype=np.int32), rows * len(ns))),
            "n_del": pa.array(np.tile(np.array(gone_sizes, np.int32), rows)), "del_idx": idx}

    return _with_orders(df, col, key, [_REP, _N_DEL, _DEL_IDX], make)


def deletion_grid(df: DataFrame, col: str = "tokens", key: Sequence[str] = ("seed",),
                  ns: Sequence[int] = DELETE_SIZES, reps: int = DELETE_REPS) -> DataFrame:
    """Baseline (n_del 0, del_idx NULL) + D3 + D4, with a ``method`` and ``rep`` column.
    For a 10-token input that is 1 + 10 + 30 = 41 variants."""
    base = (df.withColumn("method", F.lit("original")).withColumn("rep", F.lit(0))
            .withColumn("del_idx", F.lit(None).cast("string")).withColumn("n_del", F.lit(0)))
    each = delete_each(df, col).withColumn("method", F.lit("single")).withColumn("rep", F.lit(0))
    rnd = delete_random(df, col, key, ns, reps).withColumn("method", F.lit("multiple"))
    return base.unionByName(each).unionByName(rnd)


def reorder_random(df: DataFrame, col: str = "tokens", key: Sequence[str] = ("seed",),
                   reps: int = REORDER_REPS) -> DataFrame:
    """``reps`` hash-random permutations per row (identity and repeats allowed)."""
    def make(prefix: np.ndarray, n: int):
        return [n] * reps, drawn_orders(prefix, n, [str(rep) for rep in range(reps)]).reshape(len(prefix), reps * n), {
            "rep": pa.array(np.tile(np.arange(reps, dtype=np.int32), len(prefix))), "_empty": True}

    return _with_orders(df, col, key, [_REP], make)


def reorder_distinct(df: DataFrame, col: str = "tokens", key: Sequence[str] = ("seed",),
                     reps: int = REORDER_REPS) -> DataFrame:
    """D1 without repeats: ``reps`` hash-random orders per row, no two alike (all of them where
    there are fewer; the identity is one of them). The rep-th order is that of the rep-th number
    under a keyed bijection: nothing is enumerated, drawn again or compared."""
    def make(prefix: np.ndarray, n: int):
        most = min(reps, math.factorial(min(n, 20)))
        return [n] * most, numbered_orders(prefix, n, most).reshape(len(prefix), most * n), {
            "rep": pa.array(np.tile(np.arange(most, dtype=np.int32), len(prefix)))}

    return _with_orders(df.filter(F.size(col) > 0), col, key, [_REP], make)


def _factorial(n: Column) -> Column:
    return F.aggregate(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")),
                       F.lit(1).cast("bigint"), lambda a, x: a * x)


def nth_permutation(col: str, index: Column) -> Column:
    """Positions of the ``index``-th permutation (0 = identity) in lexicographic order, by the
    factorial number system: digit k picks among the positions that are left."""
    n = F.size(col)
    start = F.struct(positions(col).alias("left"), F.array().cast("array<int>").alias("out"),
                     index.cast("bigint").alias("rest"))

    def step(acc: Column, k: Column) -> Column:
        f = _factorial(n - 1 - k)
        d = F.floor(acc["rest"] / f).cast("int")
        return F.struct(F.filter(acc["left"], lambda x, i: i != d).alias("left"),
                        F.concat(acc["out"], F.array(F.get(acc["left"], d))).alias("out"),
                        (acc["rest"] % f).alias("rest"))

    return F.aggregate(positions(col), start, step, lambda acc: acc["out"])


def _permutation_table() -> Column:
    """Array by length (0 first) of all orders of range(n) but the identity, lexicographic."""
    none = F.array().cast("array<array<int>>")
    return F.array(none, none, *[
        F.array(*[F.array(*[F.lit(i) for i in p]) for p in list(itertools.permutations(range(n)))[1:]])
        for n in range(2, _TABLE_LEN + 1)])


def _numbered(df: DataFrame, last: Column, out: str) -> DataFrame:
    """``df`` with one row per number 1..``last`` (bigint; none below 1) in ``out``. Numbers come
    in blocks, so that no row holds an array of all of them."""
    none = F.array().cast("array<bigint>")
    d = df.withColumn("_last", last)
    blocks = F.when(F.col("_last") > 0, F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_last") - 1) / _BLOCK).cast("bigint"))).otherwise(none)
    d = d.select("*", F.explode(blocks).alias("_b"))
    d = d.select("*", F.explode(F.sequence(
        F.col("_b") * _BLOCK + 1, F.least((F.col("_b") + 1) * _BLOCK, F.col("_last")))).alias(out))
    return d.drop("_b", "_last")


def reorder_all(df: DataFrame, col: str = "tokens") -> DataFrame:
    """Every order except the original (n! - 1 variants; 5 for 3 tokens). ``perm_id``
    numbers the permutations in lexicographic order from 1; each is built from its number, so
    the rows come out as a stream. A row of more than 20 tokens, whose number of orders exceeds
    64 bits, fails the job."""
    n = F.size(col)
    last = F.when(n > 20, F.raise_error(F.lit("reorder_all: more than 20 tokens in a row")).cast("bigint")) \
        .otherwise(_factorial(n) - 1)
    d = _numbered(df, last, "perm_id")
    # rows of a few tokens take their orders from a literal table, the others from the number
    perm = F.when(n <= _TABLE_LEN, F.get(F.element_at(_permutation_table(), n + 1),
                                         (F.col("perm_id") - 1).cast("int"))) \
        .otherwise(nth_permutation(col, F.col("perm_id")))
    return d.withColumn("_perm", perm) \
        .withColumn(col, F.transform("_perm", lambda p: F.get(F.col(col), p))).drop("_perm")


def delete_subsets(df: DataFrame, col: str = "tokens") -> DataFrame:
    """Every non-empty subset of positions blanked (token -> ''; the slot stays), 2^n - 1
    variants. del_idx = blanked positions ascending, joined by '-'. The subsets are numbered by
    64-bit masks; a row of more than 62 tokens fails the job."""
    n = F.size(col)
    last = F.when(n > 62, F.raise_error(F.lit("delete_subsets: more than 62 tokens in a row")).cast("bigint")) \
        .otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(n, F.lit(0))) - 1)
    d = _numbered(df, last, "_m")
    bit = lambda i: F.call_function("shiftright", F.col("_m"), i).bitwiseAND(F.lit(1)) != 0
    # rows of a few tokens are written out in compiled code, the others by lambdas
    few, m = n <= _TABLE_LEN, F.col("_m").cast("int")
    names = F.array(*[F.lit("-".join(str(i) for i in range(_TABLE_LEN) if x >> i & 1)) for x in range(1 << _TABLE_LEN)])
    short = F.slice(F.array(*[F.when(m.bitwiseAND(F.lit(1 << i)) != 0, F.lit("")).otherwise(F.get(F.col(col), i))
                              for i in range(_TABLE_LEN)]), F.lit(1), n)
    long = F.transform(F.col(col), lambda t, i: F.when(bit(i), F.lit("")).otherwise(t))
    idx = F.array_join(F.transform(F.filter(positions(col), bit), lambda p: p.cast("string")), "-")
    return d.withColumn("del_idx", F.when(few, F.get(names, m)).otherwise(idx)) \
        .withColumn("n_del", F.bit_count("_m")) \
        .withColumn(col, F.when(few, short).otherwise(long)).drop("_m")


def chunk_tokens(df: DataFrame, text_col: str, size: int, out: str = "tokens") -> DataFrame:
    """Cut the whole word sequence of ``text_col`` into consecutive ``size``-word chunks
    (the last one may be shorter); adds ``chunk`` (0-based) and ``out``. The words are split
    once a row, whatever the number of chunks."""
    def cut(w: Column) -> Column:
        n = F.floor((F.size(w) + (size - 1)) / size).cast("int")
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                           lambda c: F.slice(w, c * size + 1, size))
    return df.select("*", F.posexplode(bind(words(text_col), cut)).alias("chunk", out))


def pair_perturbed(orig: DataFrame, pert: DataFrame, on: Sequence[str], label: str = "label") -> DataFrame:
    """Pair each perturbed row with its original on a caller-given key (an id, or a
    normalised text made unique upstream) and count label transitions
    (label_from, label_to, n). Perturbed rows without an original are not paired; the
    counts show what paired."""
    o = orig.select(*on, F.col(label).alias("label_from"))
    p = pert.select(*on, F.col(label).alias("label_to"), *[c for c in pert.columns if c == "pair"])
    j = o.join(p, list(on))
    keys = (["pair"] if "pair" in pert.columns else []) + ["label_from", "label_to"]
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
