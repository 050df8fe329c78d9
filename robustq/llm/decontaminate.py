"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive item words. With k = window // 2 and w = window - k + 1,
the minimum k-gram hash of every w consecutive k-grams is a fingerprint; a shared span of
``window`` words holds one full set of w k-grams, so both sides pick a fingerprint in it:
no shared window can be missed. Fingerprint matches are extended word by word (the words
themselves, not hashes) and count when the shared span reaches the window. Items of fewer
words are matched whole: documents emit the grams of exactly those lengths.

The benchmark sets a bitmap of fixed size that drops document fingerprints no item has; it is
only a prefilter (a full bitmap passes all), the join decides. The item side is broadcast
within a checked size, otherwise both sides are shuffled.

Defined cases: null or empty text has no words and no hits; an item without words matches
nothing; repeated documents are reported each; items with a null id hit but are not counted;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustq.llm.common import broadcast_if_bounded, map_texts, saved
from robustq.llm.words import Words, byte_table, gram_hashes, sliding_min

# fixed values of the contract: word bytes 0-9, A-Z, a-z and everything from 0x80
WORD_TABLE = byte_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
BITMAP_BITS = 1 << 23  # parameter: size of the prefilter

_CAND = "array<struct<pos:int,h:bigint,core:array<string>,left:array<string>,right:array<string>>>"
_CAND_TYPE = pa.list_(pa.struct([
    ("pos", pa.int32()), ("h", pa.int64()), ("core", pa.list_(pa.string())),
    ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))


def _selected(wh: np.ndarray, w: Words, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-grams (every tie of a minimum is kept)."""
    g = gram_hashes(wh, k)
    low = sliding_min(g, width)
    if not len(low):
        return np.zeros(0, np.int64), g[:0]
    # windows that cross texts are void; 0 never equals a maximum below
    p = np.arange(len(low))
    text_end = np.repeat(w.first[1:], w.counts)[:len(low)]
    low = np.where(p + k + width - 1 <= text_end, low, np.uint64(0))
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low,
                             np.zeros(width - 1, np.uint64)))
    best = np.uint64(0xFFFFFFFFFFFFFFFF) - sliding_min(np.uint64(0xFFFFFFFFFFFFFFFF) - padded,
                                                       width)
    at = np.flatnonzero((best == g) & (g != 0))
    return at, g[at]


def _candidates(col: pa.Array, window: int, lengths: list[int], bitmap, items: bool) -> list:
    """Per text: word count and candidate fingerprints with their word contexts."""
    w = Words(col, WORD_TABLE)
    wh = w.hashes()
    k = max(1, window // 2)
    width = window - k + 1
    found = [(window, k, *_selected(wh, w, k, width))]
    for n in lengths:
        g = gram_hashes(wh, n)
        p = np.arange(len(g))
        ok = p + n <= np.repeat(w.first[1:], w.counts)[:len(g)]
        if items:  # a short item is one window: the whole of it
            ok &= np.repeat(w.counts, w.counts)[:len(g)] == n
        at = np.flatnonzero(ok)
        found.append((n, n, at, g[at]))
    out = [[] for _ in range(len(col))]
    for need, size, at, g in found:
        h = (g ^ np.uint64(need * 0x9E3779B9)).view(np.int64)
        if bitmap is not None and len(at):
            bit = (h.view(np.uint64) % np.uint64(BITMAP_BITS)).astype(np.int64)
            hit = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            at, h = at[hit], h[hit]
        side = need - size
        texts = np.searchsorted(w.first, at, side="right") - 1
        for t, a, x in zip(texts.tolist(), at.tolist(), h.tolist()):
            lo, hi = int(w.first[t]), int(w.first[t + 1])
            out[t].append((a - lo, x, [w.word(i) for i in range(a, a + size)],
                           [w.word(i) for i in range(a - 1, max(lo, a - side) - 1, -1)],
                           [w.word(i) for i in range(a + size, min(hi, a + size + side))]))
    rows = [[dict(zip(("pos", "h", "core", "left", "right"), c)) for c in r] for r in out]
    return [pa.array(w.counts, pa.int64()), pa.array(rows, _CAND_TYPE)]


def _extent(a: Column, b: Column) -> Column:
    """Number of leading positions where two word arrays agree."""
    eq = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(eq, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(eq).cast("bigint"))


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of the item fingerprints; combined per 8-bit cell by Spark."""
    bit = F.expr(f"pmod(cast(h as decimal(20,0)) + if(h < 0, 18446744073709551616, 0), "
                 f"{BITMAP_BITS})").cast("bigint")
    cells = (prints.select(F.floor(bit / 8).cast("int").alias("c"),
                           (bit % 8).cast("int").alias("s"))
             .groupBy("c").agg(F.bit_or(F.expr("shiftleft(1, s)")).alias("v")))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    rows = cells.toPandas()  # at most BITMAP_BITS / 8 rows, whatever the benchmark's size
    out[rows["c"].to_numpy(np.int64)] = rows["v"].to_numpy(np.uint8)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 10, carry: Sequence[str] | None = None) -> DataFrame:
    """One row per document row: the ``carry`` columns (default: the id), n_words, spans (array of
    start/end word positions that occur in the benchmark, merged), n_hit, items (sorted distinct
    item ids as strings)."""
    spark = docs.sparkSession
    carry = [id_col] if carry is None else list(carry)
    item_words = saved(map_texts(
        items, item_text, [item_id], [("n_words", "bigint"), ("cand", _CAND)],
        lambda col: _candidates(col, window, list(range(1, window)), None, True)))
    short = sorted(r["n"] for r in item_words.where(F.col("n_words").between(1, window - 1))
                   .select(F.col("n_words").alias("n")).distinct().collect())  # < window values
    grams = (item_words.select(F.col(item_id).cast("string").alias("item"),
                               F.least(F.col("n_words"), F.lit(window)).alias("need"),
                               F.explode("cand").alias("c")).select("item", "need", "c.*"))
    # one row per distinct context; its items are attached at the end
    ctx = ["h", "need", "core", "left", "right"]
    grams = saved(grams.withColumn("ctx", F.xxhash64("h", "need", "core", "left", "right")))
    contexts = saved(grams.select("ctx", *ctx).distinct())
    bitmap = spark.sparkContext.broadcast(_bitmap(contexts.select("h")))

    base = saved(map_texts(
        docs, text, carry, [("n_words", "bigint"), ("cand", _CAND)],
        lambda col: _candidates(col, window, short, bitmap.value, False))
        .withColumn("_row", F.monotonically_increasing_id()))
    cand = base.select("_row", F.explode("cand").alias("c")).select("_row", "c.*")
    side = broadcast_if_bounded(contexts.select(
        F.col("ctx"), *[F.col(c).alias(f"i_{c}") for c in ctx]), 64 + 48 * window)
    hits = (cand.join(side, (F.col("h") == F.col("i_h")) & (F.col("core") == F.col("i_core")))
            .select("_row", "ctx", "pos", "i_need", F.size("core").alias("k"),
                    _extent(F.col("left"), F.col("i_left")).alias("l"),
                    _extent(F.col("right"), F.col("i_right")).alias("r"))
            .where(F.col("l") + F.col("k") + F.col("r") >= F.col("i_need"))
            .select("_row", "ctx", (F.col("pos") - F.col("l")).alias("s"),
                    (F.col("pos") + F.col("k") + F.col("r")).alias("e")))
    hits = saved(hits)
    # a span opens a new run when it starts beyond every earlier end
    ordered = hits.select("_row", "s", "e").distinct()
    w = Window.partitionBy("_row").orderBy("s", "e")
    runs = (ordered.withColumn("top", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("new", F.when(F.col("top").isNull() | (F.col("s") > F.col("top")), 1)
                        .otherwise(0))
            .withColumn("run", F.sum("new").over(w))
            .groupBy("_row", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
            .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"),
                                 F.sum(F.col("e") - F.col("s")).alias("n_hit")))
    named = (hits.select("_row", "ctx").distinct()
             .join(grams.select("ctx", "item").distinct(), "ctx")
             .groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    return (base.select("_row", *carry, "n_words")
            .join(runs, "_row", "left").join(named, "_row", "left")
            .select(*carry, "n_words", "spans", F.coalesce("n_hit", F.lit(0)).cast("bigint")
                    .alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
