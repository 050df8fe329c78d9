"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the
same or another document (overlaps count, documents are never joined). Sorting every position
of a corpus costs many times its size, so positions that cannot repeat are set aside first;
all three steps are exact.

1. Anchors. In every window of ``length`` bytes the smallest hash of its k-byte strings
   (rightmost tie) is the anchor: equal windows have equal anchors at equal offsets, so a window
   whose anchor string is unique is unique. Consecutive windows with one anchor are a run, and a
   run carries the hash of all bytes its windows cover. Rows: one per run, ~2 / (length - k)
   of the bytes.
2. Runs are sorted by (anchor, run hash) and read as a stream. Runs of equal bytes repeat as a
   whole: their bytes go, and one of them stands for all (within a slice of texts before
   anything is shuffled). If an anchor has runs of different
   bytes, one of each is doubtful.
3. Prefix doubling on the windows of doubtful runs. Ranks of strings of ``length / 2**rounds``
   bytes start as hashes; each round pairs the ranks at p and p + offset, Spark sorts the
   (rank, rank) pairs over all partitions, equal neighbours get one new rank, unique ones are
   dropped, and the offset doubles, until the rank length reaches ``length``. Positions that
   are left repeat.

Every table between steps is written to shared storage: a new rank is the place of its group
in one sort, which must not be sorted again differently. Streams hold one Arrow batch and the
state of one group, so a string found in any number of documents needs no memory.

Defined cases: null is the empty text; texts shorter than ``length`` lose nothing; repeated
rows (id and text) are two documents, so their long strings go; null ids are ids; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustq.llm.common import broadcast_if_bounded, row_slices, saved
from robustq.llm.words import BASE, BYTE_VALUES, mix, sliding_min, text_bytes

PIECE = 1 << 22           # parameter: window starts handled at a time within a long text
SLICE_BYTES = 2 << 20     # parameter: text bytes handled at a time
_POS = np.uint64((1 << 24) - 1)
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        got = _powers[base] = np.multiply.accumulate(x)
    return got[:n]


class Prefix:
    """Hash of any substring of a byte array from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * _power_table(BASE, n), out=self.sums[1:])
        self.back = _power_table(_INVERSE, n + 1)

    def every(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each position."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Runs of windows with one anchor: (text index, first window, windows, anchor hash, run
    hash), positions within ``data``; texts are [starts, ends)."""
    h = Prefix(data)
    g = h.every(k)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    rel = (np.arange(len(data)) - starts[owner]).astype(np.uint64)[:len(g)]
    # 40 bits of the hash, then the position so that the rightmost tie is the smallest
    low = sliding_min((g & ~_POS) | (_POS - rel), length - k + 1)
    p = np.arange(len(low))
    p = p[p + length <= ends[owner[:len(low)]]]
    anchor = (_POS - (low[p] & _POS)).astype(np.int64) + starts[owner[p]]
    if not len(p):
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(p)))
    lo = p[first]
    return owner[lo], lo, count, g[anchor[first]], h.at(lo, lo + count - 1 + length)


def _pieces(col: pa.Array, length: int) -> Iterator[tuple]:
    """(data, text rows, starts, ends, offset of each piece in its text) of the texts that
    have a window; long texts come in pieces that overlap by length - 1 bytes."""
    data, offs = text_bytes(col)
    sizes = np.diff(offs)
    rows = np.flatnonzero(sizes >= length)
    short = rows[sizes[rows] <= PIECE + length - 1]
    if len(short):
        st, en = offs[short], offs[short + 1]
        if len(short) == len(sizes):
            yield data, short, st, en, np.zeros(len(short), np.int64)
        else:
            take = np.concatenate([data[a:b] for a, b in zip(st, en)])
            n = en - st
            e = np.cumsum(n)
            yield take, short, e - n, e, np.zeros(len(short), np.int64)
    for r in rows[sizes[rows] > PIECE + length - 1].tolist():
        for at in range(0, int(sizes[r]) - length + 1, PIECE):
            part = data[offs[r] + at:min(offs[r] + at + PIECE + length - 1, offs[r + 1])]
            yield (part, np.array([r]), np.array([0]), np.array([len(part)]), np.array([at]))


_RUN_SCHEMA = "id bigint, th int, lo int, n int, known boolean, kh bigint, xh bigint"


def _anchor_runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Runs, pre-aggregated per slice of texts: runs of equal bytes within a slice are known to
    repeat (``known``, dealt out by a hash of their place, since nothing is left to decide) and
    send one run in their name. A string that a large share of all documents holds thus sends
    one row per slice to its anchor's task, not one per occurrence."""
    names = [f.split()[0] for f in _RUN_SCHEMA.split(", ")]

    def run(batches):
        for rb in row_slices(batches, "text", SLICE_BYTES):
            ids, th = rb.column(0), rb.column(1)
            parts = []
            for data, rows, st, en, at in _pieces(rb.column(2), length):
                t, lo, n, kh, xh = _runs(data, st, en, length, k)
                parts.append((rows[t], lo - st[t] + at[t], n, kh, xh))
            if not parts:
                continue
            row, lo, n, kh, xh = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((xh, kh))
            row, lo, n, kh, xh = row[order], lo[order], n[order], kh[order], xh[order]
            first = np.ones(len(kh), bool)
            first[1:] = (kh[1:] != kh[:-1]) | (xh[1:] != xh[:-1])
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] > 1
            place = mix(row.astype(np.uint64) * np.uint64(BASE) + lo.astype(np.uint64) + kh)
            for pick, known, key in ((np.flatnonzero(first), False, kh),
                                     (np.flatnonzero(many), True, place)):
                if len(pick):
                    at = pa.array(row[pick])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), th.take(at), pa.array(lo[pick], pa.int32()),
                         pa.array(n[pick], pa.int32()), pa.array(np.full(len(pick), known)),
                         pa.array(key[pick].view(np.int64)), pa.array(xh[pick].view(np.int64))],
                        names=names)
    return docs.mapInArrow(run, _RUN_SCHEMA)


def _neighbours(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """Sorted batches with each row's equality to the row before and after in the last
    ``keys`` columns: yields (batch, same_before, same_after), one row late."""
    held = None
    before = None

    def key_of(rb):
        return [rb.column(rb.num_columns - keys + i).to_numpy() for i in range(keys)]

    for rb in batches:
        if held is not None:
            rb = pa.Table.from_batches([held, rb]).combine_chunks().to_batches()[0]
        if rb.num_rows < 2:
            held = rb if rb.num_rows else None
            continue
        ks = key_of(rb)
        eq = np.ones(rb.num_rows - 1, bool)
        for x in ks:
            eq &= x[1:] == x[:-1]
        n = rb.num_rows - 1
        first = before is not None and all(x[0] == b for x, b in zip(ks, before))
        yield rb.slice(0, n), np.concatenate(([first], eq[:-1])), eq
        before = [x[n - 1] for x in ks]
        held = rb.slice(n, 1)
    if held is not None:
        first = before is not None and all(x[0] == b for x, b in zip(key_of(held), before))
        yield held, np.array([first]), np.array([False])


_SORTED_SCHEMA = "id bigint, th int, lo int, n int, doubtful boolean"


def _sorted_runs(runs: DataFrame) -> DataFrame:
    """Runs that repeat as a whole (doubtful false) and one run of each content whose anchor
    has several contents (doubtful true). Runs of unique anchors are gone."""
    names = [f.split()[0] for f in _SORTED_SCHEMA.split(", ")]
    shuffle = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def result(part, flag):
        return pa.RecordBatch.from_arrays(
            [*part.columns[:4], pa.array(np.full(part.num_rows, flag))], names=names)

    def undecided(batches, known):
        for rb in batches:
            if rb.num_rows and rb.column(4)[rb.num_rows - 1].as_py():  # sorted: known ones last
                known.append(rb.filter(rb.column(4)))
                rb = rb.filter(pc.invert(rb.column(4)))
            if rb.num_rows:
                yield rb

    def run(batches):
        group = None     # anchor of the open group
        opener = None    # its first run, not yet known to be doubtful
        known = []
        for rb, same, after in _neighbours(undecided(batches, known), 2):
            while known:
                yield result(known.pop(), False)
            kh = rb.column(5).to_numpy()
            start = np.ones(len(kh), bool)       # first row of an anchor
            start[1:] = kh[1:] != kh[:-1]
            start[0] = group is None or kh[0] != group
            content = ~same                       # first row of a run content
            doubtful = content & ~start           # a later content of an anchor
            out = [(rb.filter(pa.array(same | after)), False),
                   (rb.filter(pa.array(doubtful)), True)]
            # the opener of every anchor that shows a second content here
            g = np.cumsum(start)                  # 0: the group that was open before
            shown = np.unique(g[doubtful])
            firsts = np.flatnonzero(start)
            if len(shown) and shown[0] == 0:
                if opener is not None:
                    out.append((opener, True))
                opener = None
                shown = shown[1:]
            if len(shown):
                out.append((rb.take(pa.array(firsts[shown - 1])), True))
            if len(firsts):
                last = len(firsts)
                opener = None if len(shown) and shown[-1] == last \
                    else rb.slice(int(firsts[-1]), 1)
            group = kh[-1]
            for part, flag in out:
                if part.num_rows:
                    yield result(part, flag)
        for part in known:
            yield result(part, False)

    ordered = runs.repartition(shuffle, "kh").sortWithinPartitions("known", "kh", "xh")
    return ordered.mapInArrow(run, _SORTED_SCHEMA)


def _pairs(docs: DataFrame, blocks: DataFrame, length: int, start: int,
           offsets: list[int]) -> DataFrame:
    """Starting ranks at p and p + ``start`` of every position that later rounds look at, for
    the windows of doubtful runs. ``blocks``: (id, th, lo[], n[]) per document."""
    schema = "id bigint, th int, pos int, a bigint, b bigint"
    names = [f.split()[0] for f in schema.split(", ")]
    cond = docs["id"].eqNullSafe(blocks["id"]) & (docs["th"] == blocks["th"])
    joined = docs.join(blocks, cond).select(docs["id"], docs["th"], docs["text"], "lo", "n")

    def run(batches):
        for rb in row_slices(batches, "text", SLICE_BYTES):
            data, offs = text_bytes(rb.column(2))
            los, ns = rb.column(3).to_pylist(), rb.column(4).to_pylist()
            for r in range(rb.num_rows):
                for at, pos in _positions(los[r], ns[r], offsets, length, PIECE):
                    h = Prefix(data[offs[r] + at:offs[r] + min(at + PIECE + 2 * length,
                                                               offs[r + 1] - offs[r])])
                    g = h.every(start)
                    m = len(pos)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rb.column(0)[r].as_py()] * m, pa.int64()),
                         pa.array([rb.column(1)[r].as_py()] * m, pa.int32()),
                         pa.array(pos, pa.int32()),
                         pa.array(g[pos - at].view(np.int64)),
                         pa.array(g[pos - at + offsets[0]].view(np.int64))], names=names)
    return joined.mapInArrow(run, schema)


def _positions(lo: list[int], n: list[int], offsets: list[int], length: int,
               piece: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions whose first-round pair is needed, by piece of the text: the windows of the
    runs shifted by every sum of later offsets."""
    windows = np.concatenate([np.arange(a, a + c) for a, c in zip(lo, n)])
    shifts = np.zeros(1, np.int64)
    for o in offsets[1:]:
        shifts = np.unique(np.concatenate((shifts, shifts + o)))
    pos = np.unique((windows[:, None] + shifts[None, :]).ravel())
    for at in range(int(pos[0]) // piece * piece, int(pos[-1]) + 1, piece):
        part = pos[(pos >= at) & (pos < at + piece)]
        if len(part):
            yield at, part


def _rerank(pairs: DataFrame) -> DataFrame:
    """One sort: pairs (id, th, pos, a, b) -> (id, th, pos, rank) of the pairs that occur
    twice or more; equal pairs get one rank."""
    schema = "id bigint, th int, pos int, rank bigint"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        base = (TaskContext.get().partitionId() + 1) << 40
        count = 0
        for rb, same, after in _neighbours(batches, 2):
            rank = base + count + np.cumsum(~same)
            count += int((~same).sum())
            keep = same | after
            if keep.any():
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [*[rb.column(i).filter(mask) for i in range(3)],
                     pa.array(rank[keep], pa.int64())], names=names)

    return pairs.orderBy("a", "b").mapInArrow(run, schema)


def _doubled(ranks: DataFrame, offset: int) -> DataFrame:
    """Ranks at p and p + offset of one document; positions without a partner are unique."""
    left = ranks.select("id", "th", "pos", F.col("rank").alias("a"))
    right = ranks.select(F.col("id").alias("id2"), F.col("th").alias("th2"),
                         (F.col("pos") - offset).alias("pos2"), F.col("rank").alias("b"))
    cond = (F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
            & (F.col("pos") == F.col("pos2")))
    return left.join(right, cond).select("id", "th", "pos", "a", "b")


def schedule(length: int, rounds: int) -> tuple[int, list[int]]:
    """Starting rank length and the offset of each round; the last one reaches ``length``."""
    start = -(-length // (1 << rounds))
    offsets, have = [], start
    while have < length:
        step = min(have, length - have)
        offsets.append(step)
        have += step
    return start, offsets


def _merged(spans: DataFrame) -> DataFrame:
    """(id, th, s, e) rows -> (id, th, spans): sorted, disjoint, non-touching [s0, e0, s1, ...]."""
    schema = "id bigint, th int, spans array<int>"

    def run(batches):
        for rb in batches:
            out = []
            for xs in rb.column(2):
                v = np.array(xs.values.field(0)), np.array(xs.values.field(1))
                order = np.argsort(v[0], kind="stable")
                s, e = v[0][order], np.maximum.accumulate(v[1][order])
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > e[:-1]
                last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
                out.append(np.stack((s[new], e[last]), axis=1).ravel())
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), pa.array(out, pa.list_(pa.int32()))],
                names=["id", "th", "spans"])

    grouped = spans.groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    return grouped.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = 400, anchor: int | None = None,
                   rounds: int = 1) -> DataFrame:
    """(id, th, spans) of the documents (id, th, text) that lose bytes."""
    k = anchor or max(1, length * 3 // 4)
    found = saved(_sorted_runs(_anchor_runs(docs, length, k)))
    whole = found.where(~F.col("doubtful")).select(
        "id", "th", F.col("lo").alias("s"),
        (F.col("lo") + F.col("n") - 1 + length).cast("int").alias("e"))
    blocks = saved(found.where("doubtful").groupBy("id", "th").agg(
        F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n")))
    side = broadcast_if_bounded(blocks, F.size("lo") * 8 + 64)
    start, offsets = schedule(length, rounds)
    ranks = saved(_rerank(_pairs(docs, side, length, start, offsets)))
    for offset in offsets[1:]:
        ranks = saved(_rerank(_doubled(ranks, offset)))
    single = ranks.select("id", "th", F.col("pos").alias("s"),
                          (F.col("pos") + length).cast("int").alias("e"))
    return saved(_merged(whole.unionByName(single)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   length: int = 400, anchor: int | None = None, rounds: int = 1) -> DataFrame:
    """One row per document row: id, n_bytes, spans (removed byte runs [s0, e0, s1, ...]),
    n_removed, kept_sha256, kept (the remaining bytes)."""
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    d = d.withColumn("th", F.hash("text")).select("id", "th", "text")
    spans = repeated_spans(d, length, anchor, rounds)
    side = broadcast_if_bounded(spans, F.size("spans") * 4 + 64)
    cond = d["id"].eqNullSafe(side["id"]) & (d["th"] == side["th"])
    joined = d.join(side, cond, "left").select(d["id"], "text", "spans")
    schema = (f"`{id_col}` bigint, n_bytes bigint, spans array<int>, n_removed bigint, "
              "kept binary, kept_sha256 string")

    def run(batches):
        for rb in row_slices(batches, "text"):
            cut, texts = rb.column(2).to_pylist(), rb.column(1).to_pylist()
            kept, removed = [], []
            for t, c in zip(texts, cut):
                b = t.encode("utf-8", "surrogatepass")
                edges = [0, *(c or []), len(b)]
                left = b"".join(b[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
                kept.append(left)
                removed.append(len(b) - len(left))
            n = [len(x) + r for x, r in zip(kept, removed)]
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(n, pa.int64()),
                 pa.array([c or [] for c in cut], pa.list_(pa.int32())),
                 pa.array(removed, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                names=[id_col, "n_bytes", "spans", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(run, schema)
