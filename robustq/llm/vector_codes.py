"""Vector code compression: product codes learnt by Lloyd rounds over cover trees.

Vectors are scaled to integers and cut into equal parts; every part position has a codebook that
a fixed number of Lloyd rounds refines. The rows of a partition are cut into blocks, and each
block holds, per part position, a cover tree over its part vectors: nodes keep a centre, the
radius of their subtree, its number of points and their componentwise sum. The blocks are written
to shared storage once and every round reads them: a node whose nearest entry is nearer than any
other by more than twice its radius gives its whole subtree (sum and count) to that entry; only
the other nodes descend, at last to exact comparisons of single points. Distances and sums are
integers, so the result does not depend on blocks, partitions or retries; what reaches the driver
per round is one sum and count per codebook entry.

Defined cases: rows whose vector is null, holds a null, is not finite or has a component of
16,384 or more in size (``LIMIT``, so that all distances fit 64 bits) are dropped. The vector
length is the commonest among the others that the number of parts divides (ties: the longer);
rows of other lengths are dropped, too. Null ids come last; equal ids are ordered by their vector. With fewer rows
than entries the codebooks have as many entries as rows. Repeated rows count like any others; an
empty table gives an empty result. Extra columns are not read. ``label_error`` is null where the
sum does not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustq.llm.common import broadcast_if_bounded, saved

# Parameters
BLOCK_ROWS = 4096   # rows of one block: about 1.5 MB with its trees at 64 dimensions
LEAF_ROWS = 24      # points below which a node is not split
SALTS = 32          # copies of a label's sum where it cannot be broadcast
# fixed values of the contract
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 1 << 26     # size of a scaled component


# -- cover trees ----------------------------------------------------------------------
@dataclass
class Tree:
    """Points in subtree order and nodes in breadth-first order: node i covers points
    ``lo[i]:hi[i]`` around ``centre[i]`` within ``radius[i]`` and has the nodes
    ``first[i]:last[i]`` below it (none: a leaf)."""

    points: np.ndarray
    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray
    radius: np.ndarray
    centre: np.ndarray
    total: np.ndarray

    FIELDS = ("points", "order", "lo", "hi", "first", "last", "radius", "centre", "total")


def build_tree(points: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    """Cover tree of integer points (n x d, int64), from the top: the children of a node are
    points of it more than half its radius apart (the node's own centre first, then the farthest
    point each time) until all its points are within half of the radius of one; each point goes
    to its nearest child. Equal points are a node of radius 0."""
    pts = points.astype(np.int64)
    order = np.arange(len(pts))
    lo, hi, first, last, radius, centre = [0], [len(pts)], [], [], [], [0]
    i = 0
    while i < len(lo):
        a, b = lo[i], hi[i]
        mine = order[a:b]
        p = pts[mine]
        near = ((p - pts[centre[i]]) ** 2).sum(1) if b > a else np.zeros(0, np.int64)
        far = int(near.max()) if b > a else 0
        radius.append(np.sqrt(float(far)))
        first.append(len(lo))
        if b - a > leaf and far > 0:
            owner = np.zeros(b - a, np.int64)
            chosen = [centre[i]]
            while True:
                k = int(near.argmax())
                if 4 * int(near[k]) <= far:
                    break
                d = ((p - p[k]) ** 2).sum(1)
                closer = d < near
                near[closer] = d[closer]
                owner[closer] = len(chosen)
                chosen.append(mine[k])
            by = np.argsort(owner, kind="stable")
            order[a:b] = mine[by]
            sizes = np.bincount(owner, minlength=len(chosen))
            ends = a + np.cumsum(sizes)
            lo.extend((ends - sizes).tolist())
            hi.extend(ends.tolist())
            centre.extend(int(c) for c in chosen)
        last.append(len(lo))
        i += 1
    low, high = np.array(lo), np.array(hi)
    run = np.vstack([np.zeros((1, pts.shape[1]), np.int64), np.cumsum(pts[order], axis=0)])
    return Tree(pts[order], order, low, high, np.array(first), np.array(last), np.array(radius),
                pts[np.array(centre)] if len(pts) else np.zeros((1, pts.shape[1]), np.int64),
                run[high] - run[low])


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, points x entries, exact: float products while they stay below 2**53."""
    top = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    if points.shape[1] * top * top < 1 << 50:
        p, c = points.astype(np.float64), book.astype(np.float64)
        d = (p * p).sum(1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(1)[None, :]
        return d.astype(np.int64)
    return ((points[:, None, :] - book[None, :, :]) ** 2).sum(2)


def assign(tree: Tree, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(items, entries, whole): nodes (``whole``) or single points and the nearest entry of each,
    together covering every point once. Ties go to the lower entry."""
    level = np.zeros(1 if len(tree.points) else 0, np.int64)
    while len(level):
        d = squared(tree.centre[level], book)
        best = d.argmin(1)
        root = np.sqrt(d.astype(np.float64))
        # an entry can only win a point of the subtree within this distance of the centre; the
        # slack covers the rounding of the roots and keeps ties undecided
        reach = (root[np.arange(len(level)), best] + 2 * tree.radius[level]) * (1 + 1e-9) + 1e-6
        rivals = (root <= reach[:, None]).sum(1) > 1
        same = tree.radius[level] == 0  # all points are the centre: exact
        sure = ~rivals | same
        yield level[sure], best[sure], True
        open_ = level[~sure]
        leaves = tree.first[open_] == tree.last[open_]
        rows = _ranges(tree.lo[open_[leaves]], tree.hi[open_[leaves]])
        if len(rows):
            yield rows, squared(tree.points[rows], book).argmin(1), False
        inner = open_[~leaves]
        level = _ranges(tree.first[inner], tree.last[inner])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo:hi, one after the other."""
    n = hi - lo
    if not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())


def sums_of(tree: Tree, book: np.ndarray) -> np.ndarray:
    """Per entry: componentwise sums of its points, then their number (entries x (d + 1))."""
    out = np.zeros((len(book), book.shape[1] + 1), np.int64)
    for items, entry, whole in assign(tree, book):
        if whole:
            np.add.at(out[:, :-1], entry, tree.total[items])
            np.add.at(out[:, -1], entry, tree.hi[items] - tree.lo[items])
        else:
            np.add.at(out[:, :-1], entry, tree.points[items])
            np.add.at(out[:, -1], entry, 1)
    return out


def codes_of(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the order the points were given."""
    code = np.empty(len(tree.points), np.int64)
    for items, entry, whole in assign(tree, book):
        if whole:
            code[_ranges(tree.lo[items], tree.hi[items])] = np.repeat(entry, tree.hi[items] - tree.lo[items])
        else:
            code[items] = entry
    out, err = np.empty_like(code), np.empty_like(code)
    out[tree.order] = code
    err[tree.order] = ((tree.points - book[code]) ** 2).sum(1) if len(code) else 0
    return out, err


# -- blocks ---------------------------------------------------------------------------
def pack_tree(t: Tree) -> bytes:
    import io
    f = io.BytesIO()
    small = {"points": np.int32, "centre": np.int32, "order": np.int32, "lo": np.int32,
             "hi": np.int32, "first": np.int32, "last": np.int32}
    np.savez(f, **{k: getattr(t, k).astype(small.get(k, getattr(t, k).dtype)) for k in Tree.FIELDS})
    return f.getvalue()


def unpack_tree(raw: bytes) -> Tree:
    import io
    with np.load(io.BytesIO(raw)) as z:
        t = Tree(**{k: z[k] for k in Tree.FIELDS})
    for k in ("points", "centre", "order", "lo", "hi", "first", "last"):
        setattr(t, k, getattr(t, k).astype(np.int64))
    return t


def scaled(vector: str | Column) -> Column:
    """floor(4096 * component) as integers; null for a vector that is dropped."""
    v = F.col(f"`{vector}`") if isinstance(vector, str) else vector
    usable = v.isNotNull() & F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * SCALE < LIMIT), F.lit(False)))
    return F.when(usable, F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")))


def usable_rows(vectors: DataFrame, id_col: str, vector: str, label: str, parts: int) -> DataFrame:
    """(id, label, x) of the rows that are kept."""
    d = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                       F.col(f"`{label}`").alias("label"), scaled(vector).alias("x")) \
        .where(F.col("x").isNotNull())
    top = (d.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
           .where((F.col("n") > 0) & (F.col("n") % parts == 0))
           .orderBy(F.col("rows").desc(), F.col("n").desc()).limit(1).collect())
    return d.where(F.size("x") == (top[0]["n"] if top else -1))


def blocks(rows: DataFrame, parts: int, block_rows: int = BLOCK_ROWS, leaf: int = LEAF_ROWS) -> DataFrame:
    """(ids, labels, trees): partition-local blocks of at most ``block_rows`` rows, one packed
    tree per part position."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for rb in batches:
            for at in range(0, rb.num_rows, block_rows):
                b = rb.slice(at, block_rows)
                x = np.asarray(b.column(2).flatten()).reshape(b.num_rows, parts, -1)
                trees = [pack_tree(build_tree(x[:, p], leaf)) for p in range(parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.to_pylist()], pa.list_(c.type)) for c in (b.column(0), b.column(1))]
                    + [pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, trees array<binary>")


def lloyd_sums(trees: DataFrame, books: list[np.ndarray]) -> dict[int, int]:
    """Sums and counts of one assignment over all blocks by flat position (part, entry,
    component; the count last). One partial array per task, summed by Spark."""
    def run(batches):
        total = None
        for rb in batches:
            for one in rb.column(0):
                s = np.concatenate([sums_of(unpack_tree(t.as_py()), b).ravel()
                                    for t, b in zip(one, books)])
                total = s if total is None else total + s
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())],
                                             names=["at", "s"])

    got = trees.select("trees").mapInArrow(run, "at bigint, s bigint") \
        .groupBy("at").agg(F.sum("s").alias("s"))
    return {r["at"]: r["s"] for r in got.collect()}


def next_books(books: list[np.ndarray], sums: dict[int, int]) -> list[np.ndarray]:
    """Every entry replaced by the floored mean of its points; unused entries stay."""
    out, at = [], 0
    for b in books:
        new = b.copy()
        width = b.shape[1] + 1
        for e in range(len(b)):
            n = sums.get(at + width - 1, 0)
            if n:
                new[e] = [sums.get(at + k, 0) // n for k in range(width - 1)]
            at += width
        out.append(new)
    return out


def fit_books(trees: DataFrame, first: np.ndarray, parts: int, rounds: int) -> list[np.ndarray]:
    """Codebooks (entries x components) per part position from the vectors ``first``."""
    books = [b.copy() for b in first.reshape(len(first), parts, -1).transpose(1, 0, 2)]
    for _ in range(rounds):
        books = next_books(books, lloyd_sums(trees, books))
    return books


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for b in books for v in b.ravel())


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, codes array<int>, error bigint), codebooks): the nearest entry of every part
    of every kept row after ``rounds`` Lloyd rounds, and the summed squared distances."""
    rows = usable_rows(vectors, id_col, vector, label, parts)
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"id bigint, label {kind}, codes array<int>, error bigint"
    head = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    if not head:
        return rows.sparkSession.createDataFrame([], schema), []
    trees = saved(blocks(rows, parts, block_rows))
    books = fit_books(trees, np.array([r["x"] for r in head], np.int64), parts, rounds)

    def run(batches):
        for rb in batches:
            for ids, labels, one in zip(*rb.columns):
                got = [codes_of(unpack_tree(t.as_py()), b) for t, b in zip(one, books)]
                codes = np.stack([c for c, _ in got], axis=1).astype(np.int32)
                offsets = np.arange(0, codes.size + 1, parts, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values,
                     pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())),
                     pa.array(sum(e for _, e in got))], names=["id", "label", "codes", "error"])

    return trees.mapInArrow(run, schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels (nulls together). The
    sums are pre-aggregated by label; they are broadcast within a checked size and salted beyond
    it, so no task gathers the rows of one label."""
    d = saved(coded)
    sums = saved(d.groupBy("label").agg(F.try_sum("error").alias("label_error"))
                 .withColumnRenamed("label", "_l"))
    small = broadcast_if_bounded(sums, 32)
    if small is not sums:
        return d.join(small, d["label"].eqNullSafe(small["_l"]), "left").drop("_l")
    salted = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.withColumn("_t", F.pmod(F.xxhash64("id", "codes"), F.lit(SALTS)).cast("int"))
    return d.join(salted, d["label"].eqNullSafe(salted["_l"]) & (d["_t"] == salted["_s"]), "left") \
        .drop("_l", "_s", "_t")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
