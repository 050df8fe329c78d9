"""SimHash near-duplicates by multi-index hashing.

1. Fingerprint: XXH64 (seed 42) of every word shingle; bit i is set if it is set in over half
   of the shingle hashes. Row-local numpy inside an Arrow map.
2. Distinct fingerprints only from here on: exact copies, however many, are one row.
3. Multi-index tables: the fingerprint is cut into ``m`` segments. With r = d // m and
   a = d - m*r, two fingerprints within d bits agree within r bits on one of the first a + 1
   segments or within r - 1 bits on one of the others. Each fingerprint is stored once per
   segment value and probes with the Hamming ball of that small radius around its segment.
4. Matches are verified by the full distance. A table bucket (or the probes of one) with more
   than ``BUCKET_ROWS`` fingerprints would make a product; its fingerprints go another, exact
   way: with d = 2 * r2 (+1), two fingerprints within d bits share a point of their full
   Hamming balls of radius r2 and ceil(d / 2); grouping by the point links each member to the
   smallest one in a star, a number of rows linear in the bucket.
5. Components by minimum labels over the links.

Defined cases: null or wordless text has fingerprint zero and is linked like any other; fewer
words than a shingle: the whole sequence is the one shingle; rows with a null id are kept and
never name a component for others unless alone (their component is null); repeated rows share
a component; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustq.llm.common import broadcast_if_bounded, join_by_any, map_texts, saved
from robustq.llm.graph import connected_components

SEED = 42          # fixed value of the contract
BUCKET_ROWS = 64   # parameter: larger buckets take the star route (same links' closure)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    spans = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    h = np.array([digest(view[s:e], SEED) for s, e in spans], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at:at + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp) with fp as a signed long."""
    def fn(col):
        fps = [simhash(t, shingle) for t in col.to_pylist()]
        return [pa.array(np.array(fps, np.uint64).view(np.int64))]
    return map_texts(docs, text, [id_col], [("fp", "bigint")], fn)


def _segments(m: int) -> list[tuple[int, int]]:
    """(offset, width) of m segments of 64 bits."""
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _ball(width: int, radius: int) -> list[int]:
    """XOR masks of the Hamming ball, as signed 64-bit values."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1)
             for c in combinations(range(width), r)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def _part(fp: Column, offset: int, width: int) -> Column:
    s = F.shiftrightunsigned(fp, offset)
    return s if offset + width == 64 else s.bitwiseAND(F.lit((1 << width) - 1))


def _array(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L-1L)"
                                      for v in values) + ")")


def fingerprint_links(fps: DataFrame, max_bits: int = 2, m: int = 2,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose closure is that of all pairs within
    ``max_bits``. Every link of an ordinary bucket is a verified pair; hot buckets give stars
    through shared ball points."""
    r, extra = divmod(max_bits, m)
    fps = saved(fps.select("fp").distinct())
    table, probes = [], []
    for i, (off, width) in enumerate(_segments(m)):
        radius = r if i <= extra else r - 1
        if radius < 0:
            continue
        part = _part(F.col("fp"), off, width)
        table.append(fps.select(F.lit(i).alias("seg"), part.alias("v"), "fp"))
        probes.append(fps.select(
            F.lit(i).alias("seg"),
            F.explode(F.transform(_array(_ball(width, radius)), lambda x: part.bitwiseXOR(x)))
            .alias("v"), "fp"))
    stored = table[0]
    probe = probes[0]
    for t, p in zip(table[1:], probes[1:]):
        stored, probe = stored.unionByName(t), probe.unionByName(p)
    # bucket sizes, combined on the map side
    size = stored.groupBy("seg", "v").agg(F.count(F.lit(1)).alias("n"))
    hot = saved(size.where(F.col("n") > bucket_rows).select("seg", "v"))
    if hot.isEmpty():
        cold_stored, hot_fps = stored, None
    else:
        cold_stored = stored.join(hot, ["seg", "v"], "left_anti")
        hot_fps = probe.join(hot, ["seg", "v"], "left_semi").select("fp").distinct()
    pairs = (cold_stored.alias("t").join(probe.alias("p"), ["seg", "v"])
             .select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
             .where(F.col("a") != F.col("b"))
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if hot_fps is None:
        return pairs
    lo, hi = max_bits // 2, max_bits - max_bits // 2
    near = hot_fps.select("fp", F.explode(F.transform(
        _array(_ball(64, lo)), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    if lo == hi:
        star = near.groupBy("point").agg(F.min("fp").alias("c"), F.max("fp").alias("x"))
        star = star.where(F.col("c") != F.col("x")).select("point", "c")
        links = near.join(star, "point").select(F.col("fp").alias("a"), F.col("c").alias("b"))
    else:
        # an odd distance: a point at distance hi from one and lo from the other; pairs that
        # meet only at distance hi on both sides (max_bits + 1 apart) are not linked, so each
        # wide member is linked with the smallest narrow one
        wide = hot_fps.select("fp", F.explode(F.transform(
            _array(_ball(64, hi)), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
        narrow = near.groupBy("point").agg(F.min("fp").alias("c"))
        links = (wide.join(narrow, "point").select(F.col("fp").alias("a"), F.col("c").alias("b"))
                 .union(near.join(narrow, "point").select(F.col("fp").alias("a"),
                                                          F.col("c").alias("b"))))
    return pairs.union(links.where(F.col("a") != F.col("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle: int = 3, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """One row per input row: (id, fp, component_id); component_id is the smallest id whose
    fingerprint is reachable over links of at most ``max_bits`` differing bits."""
    fp = saved(fingerprints(docs, id_col, text, shingle))
    distinct = fp.groupBy("fp").agg(F.min(id_col).alias("first"))
    comps = connected_components(fingerprint_links(distinct, max_bits, segments))
    # the smallest id of a component of fingerprints
    named = (distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("root", F.coalesce("component", "fp")))
    root = named.groupBy("root").agg(F.min("first").alias("component_id"))
    cls = saved(named.select("fp", "root").join(root, "root").select("fp", "component_id"))
    return join_by_any(fp, cls, ["fp"], F.col(id_col), 32).select(id_col, "fp", "component_id")


def hex_fp(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
               max_bits: int = 2) -> DataFrame:
    """Pipeline form: drops every row whose id is not the one that names its component. Rows
    that share an id are one document; rows with a null id stay."""
    nd = near_duplicates(docs, id_col, text, shingle, max_bits)
    drop = saved(nd.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    return docs.join(broadcast_if_bounded(drop, 16), id_col, "left_anti")
