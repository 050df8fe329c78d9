"""Dataset preparation (B): renames, label encoding, validation, samples, splits,
context picking, object swapping, vocabulary encoding, truncation, batching.

Random choices are md5 ranks (``hkey``). Ranks over a whole table use either a filtered
window (``rn <= k`` becomes a per-task partial top-k before the shuffle) or the skew-safe
global numbering in :mod:`robustq.functions.ranking`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustq.functions.hashing import hkey, hnum
from robustq.functions.ranking import global_position, row_number_within
from robustq.functions.text import split_pieces, words

# fixed values
CLASSES = ["entailment", "contradiction", "neutral"]  # ClassLabel order = JSON map order
NESTED_SIZES = [10, 15, 20, 32, 50, 70, 100]
SPECIAL_IDS = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "<mask>": 4}
PAD_ID = 1
UNK_ID = 3
MAX_SEQ = 256


# -- B1 -----------------------------------------------------------------------------
def standardize(pairs: DataFrame) -> DataFrame:
    """sentence_a -> premise, sentence_b -> hypothesis, ex_id -> idx; four columns. idx is
    the example's key as it is (int32 would not hold the keys of a large table)."""
    return pairs.select(F.col("sentence_a").alias("premise"), F.col("sentence_b").alias("hypothesis"),
                        F.col("ex_id").alias("idx"), "label")


# -- B2 -----------------------------------------------------------------------------
def encode_fixed(df: DataFrame, classes: Sequence[str] = CLASSES, col: str = "label") -> DataFrame:
    """Fixed class order; an unknown label fails the job (the reference raises)."""
    lab = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)],
                                          f"{col} string, class_id int")
    j = df.join(F.broadcast(lab), col, "left")  # class table: one row per class
    return j.withColumn("class_id", F.when(F.col("class_id").isNull(),
                                           F.raise_error(F.concat(F.lit("unknown label: "), F.col(col))))
                        .otherwise(F.col("class_id")).cast("int"))


# -- B3 -----------------------------------------------------------------------------
def encode_first_seen(df: DataFrame, order_cols: Sequence[str], col: str = "label") -> DataFrame:
    """Class id = order of first appearance along ``order_cols`` (e.g. split order, then row
    order); later splits reuse and extend the same map. One row per distinct label is
    ranked (partial aggregation keeps the shuffle to labels x tasks)."""
    first = df.groupBy(col).agg(F.min(F.struct(*order_cols)).alias("_first"))
    ids = first.select(col, (F.row_number().over(Window.orderBy("_first")) - 1).cast("int").alias("class_id"))
    return df.join(ids, col)  # AQE broadcasts the per-label table when small


# -- B4 -----------------------------------------------------------------------------
def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Apply named reject rules in order; returns (valid, rejected-with-reason)."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(list(rules.items())):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def split_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested fact records: those without evidences are set aside with a reason."""
    return split_valid(facts, {"no_evidences": F.coalesce(F.size("evidences"), F.lit(-1)) <= 0})


def require_label(df: DataFrame, col: str = "label") -> DataFrame:
    """A null label is fatal: the job fails when such a row is read."""
    bad = F.raise_error(F.concat(F.lit("a row has no label: "), F.to_json(F.struct(*df.columns))))
    return df.withColumn(col, F.when(F.col(col).isNull(), bad).otherwise(F.col(col)).cast("string"))


# -- B5 -----------------------------------------------------------------------------
def sample_exact(df: DataFrame, n: int, seed: int, key: str = "ex_id", check: bool = True) -> DataFrame:
    """Uniform sample of exactly ``n`` rows without replacement (md5 order + limit, a
    distributed top-n). n larger than the population is an error; n = 0/None = all rows."""
    if not n:
        return df
    top = df.orderBy(hkey(F.lit(str(seed)), key), F.col(key)).limit(n)
    if not check:
        return top
    # one pass over the data: the n-row sample is written once and counted; fewer rows
    # than asked means the population was smaller (no separate count of the whole table)
    from robustq.functions.materialize import materialize
    top = materialize(top)
    got = top.count()
    if got < n:
        raise ValueError(f"sample larger than population: {n} > {got}")
    return top


# -- B6 -----------------------------------------------------------------------------
def nested_subsets(df: DataFrame, seeds: Sequence[int], sizes: Sequence[int] = NESTED_SIZES,
                   key: str = "ex_id") -> DataFrame:
    """(seed, size, rows...): per seed the first ``size`` rows by md5(seed:key), so every
    smaller subset is a prefix of the larger ones."""
    s = df.select(F.explode(F.array(*[F.lit(x) for x in seeds])).alias("seed"), "*")
    w = Window.partitionBy("seed").orderBy(hkey("seed", key), F.col(key))
    s = s.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(sizes))
    return (s.withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes])))
            .filter(F.col("rn") <= F.col("size")))


# -- B7 -----------------------------------------------------------------------------
def holdout(df: DataFrame, n: int, seed: int, key: str = "ex_id") -> tuple[DataFrame, DataFrame]:
    """(train, dev): dev = the ``n`` rows first in md5(seed:key) order; train = the rest
    (left anti join, disjoint by construction)."""
    from robustq.functions.materialize import materialize, rows_within
    # the n dev rows (bounded by the parameter) are written once: dev and the anti join
    # behind train both read them, so the top-n pass over the data runs once
    dev = materialize(df.orderBy(hkey(F.lit(str(seed)), key), F.col(key)).limit(n))
    keys = dev.select(key)
    train = df.join(F.broadcast(keys) if n <= rows_within(64) else keys, key, "left_anti")
    return train, dev


# -- B8 -----------------------------------------------------------------------------
def pick_context(facts: DataFrame, seed: int, max_words: int | None = None,
                 fact_cols: Sequence[str] = ("sub_label", "obj_label"), id_col: str = "ev_id") -> DataFrame:
    """One evidence per fact (smallest md5(seed:id), partially aggregated so a hot fact
    costs one row per task), optional word cap, ``[MASK]`` replaced by its surface."""
    pick = facts.groupBy(*fact_cols).agg(F.min_by(F.struct("obj_surface", "masked_sentence"),
                                                  hkey(F.lit(str(seed)), id_col)).alias("e"))
    ctx = F.col("e.masked_sentence")
    if max_words:
        ctx = F.array_join(F.slice(words(ctx), 1, max_words), " ")
    return pick.select(*fact_cols, F.replace(ctx, F.lit("[MASK]"), F.col("e.obj_surface")).alias("context"))


# -- B9 -----------------------------------------------------------------------------
MAX_CONTEXT = 50  # fixed value: words of a fact's context


def swap_objects(facts: DataFrame, seed: int, fact_cols: Sequence[str] = ("sub_label", "obj_label"),
                 id_col: str = "ev_id", max_words: int | None = MAX_CONTEXT) -> DataFrame:
    """One row per fact: its picked evidence (B8's draw, at most ``max_words`` words) with a
    random *different* object label and a random surface of that label in place of
    ``[MASK]``. Surfaces are drawn by occurrence (over all evidences, not de-duplicated)."""
    from robustq.functions.materialize import concurrently

    def numbered_labels():
        lab = global_position(facts.select("obj_label").distinct(), ["obj_label"], "lidx")
        return lab, lab.count()  # one row per object label

    # surfaces ranked within their label, skew-safe (a label may own a third of all rows);
    # independent of the label numbering, so both run at the same time
    (labels, k), surf = concurrently(
        numbered_labels,
        lambda: row_number_within(facts.select("obj_label", "obj_surface", id_col), ["obj_label"],
                                  [id_col], "sidx"))
    if k < 2:
        raise ValueError("swap_objects needs at least two object labels")
    n_surf = facts.groupBy("obj_label").agg(F.count(F.lit(1)).alias("n_surf"))
    # both label tables have k rows (counted above): broadcast only within the limit,
    # otherwise shuffle joins on the label
    from robustq.functions.materialize import rows_within
    small = F.broadcast if k <= rows_within(128) else (lambda d: d)
    pick = facts.groupBy(*fact_cols).agg(F.min_by(
        F.struct(id_col, "masked_sentence"), hkey(F.lit(str(seed)), id_col)).alias("e"))
    masked = F.col("e.masked_sentence")
    if max_words:
        masked = F.array_join(F.slice(words(masked), 1, max_words), " ")
    f = pick.select(*fact_cols, F.col(f"e.{id_col}").alias(id_col), masked.alias("masked_sentence"))
    f = f.join(small(labels), "obj_label")
    h = hnum(F.lit(str(seed)), *fact_cols)
    f = f.withColumn("new_lidx", (F.col("lidx") + 1 + h % (k - 1)) % k)
    f = f.join(small(labels.select(F.col("lidx").alias("new_lidx"),
                                   F.col("obj_label").alias("new_label"))), "new_lidx")
    f = f.join(small(n_surf.withColumnRenamed("obj_label", "new_label")), "new_label")
    f = f.withColumn("sidx", hnum(F.lit(str(seed)), id_col) % F.col("n_surf") + 1)
    s = surf.select(F.col("obj_label").alias("new_label"), "sidx", F.col("obj_surface").alias("new_surface"))
    f = f.join(s, ["new_label", "sidx"])
    return f.select(*[c for c in fact_cols if c != "obj_label"], F.col("new_label").alias("obj_label"),
                    F.replace(F.col("masked_sentence"), F.lit("[MASK]"), F.col("new_surface")).alias("context"))


# -- B10 ----------------------------------------------------------------------------
def build_vocab(df: DataFrame, col: str = "text") -> DataFrame:
    """(token, token_id, freq): whitespace words ranked by (freq desc, token), ids after the
    reserved ones; numbering is skew-safe (no single-partition window)."""
    wc = (df.select(F.explode(split_pieces(col)).alias("token")).filter(F.col("token") != "")
          .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    pos = global_position(wc, [F.col("freq").desc(), F.col("token")], "_p", keys=["freq", "token"])
    return pos.select("token", (F.col("_p") + len(SPECIAL_IDS)).alias("token_id"), "freq")


DICTIONARY_WORDS = 300_000  # parameter: most words of the dictionary that every task holds
HOT_CHARS = 64    # parameter: longest word of the dictionary
CHUNK_BYTES = 1 << 20  # parameter: text bytes of the rows that a task encodes at a time


def _dictionary(vocab: DataFrame) -> dict[str, int]:
    """Ids of the most frequent words, ``DICTIONARY_WORDS`` at most (without frequencies: none)."""
    if "freq" not in vocab.columns:
        return {}
    # n occurrences have less than sqrt(2 n) different frequencies
    of_freq = vocab.where("freq is not null").groupBy("freq").agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = None, DICTIONARY_WORDS
    for r in sorted(of_freq, reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["freq"]
    if least is None:
        return {}
    hot = vocab.where((F.col("freq") >= least) & (F.length("token") <= HOT_CHARS) & F.col("token_id").isNotNull())
    return {r["token"]: r["token_id"] for r in hot.select("token", "token_id").collect()}


def _word_list(text: str | None) -> list[str]:
    """Python's form of :func:`words` (null: none)."""
    text = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ")
    return list(filter(None, text.split(" ")))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about ``CHUNK_BYTES`` of ``_text`` (a row is never cut)."""
    for rb in batches:
        size = pc.fill_null(pc.binary_length(rb["_text"]), 0).to_numpy(zero_copy_only=False)
        chunk = size.cumsum(dtype="int64") // CHUNK_BYTES
        ends = [*(chunk[1:] != chunk[:-1]).nonzero()[0] + 1, rb.num_rows]
        for at, end in zip([0, *ends], ends):
            yield rb.slice(at, end - at)


def _rare_words(d: DataFrame, hot: Broadcast) -> DataFrame:
    """(_row, token): each row's different words that the dictionary does not have."""
    def run(batches):
        for rb in _slices(batches):
            rows, tokens = [], []
            for row, text in zip(rb["_row"].to_pylist(), rb["_text"].to_pylist()):
                rare = set(_word_list(text)).difference(hot.value)
                rows += [row] * len(rare)
                tokens += rare
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(tokens, pa.string())],
                                             names=["_row", "token"])
    return d.select("_row", "_text").mapInArrow(run, "_row bigint, token string")


class _Ids(dict):
    """The dictionary, then the words of one row, then <unk>."""

    def __missing__(self, word: str) -> int:
        return self.row.get(word, UNK_ID)


def _looked_up(d: DataFrame, hot: Broadcast, out: str) -> DataFrame:
    """``out``, the ids of ``_text``, in the place of ``_text`` and the row's own words ``_tokens``
    and their ids ``_found`` (null: none)."""
    kept = [c for c in d.columns if c not in ("_text", "_tokens", "_found")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*kept).schema.fields)

    def run(batches):
        ids = _Ids(hot.value)
        for rb in _slices(batches):
            flat, ends = [], [0]
            for text, tokens, found in zip(*(rb[c].to_pylist() for c in ("_text", "_tokens", "_found"))):
                ids.row = dict(zip(tokens or (), found or ()))
                flat += map(ids.__getitem__, _word_list(text))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rb[c] for c in kept), lists], names=[*kept, out])
    return d.mapInArrow(run, f"{fields}, `{out}` array<bigint>")


def encode_tokens(df: DataFrame, col: str, vocab: DataFrame, key: str | Sequence[str] = "ex_id",
                  out: str = "ids") -> DataFrame:
    """Words of ``col`` -> ids (unknown -> <unk>), in position order; one row per input row, rows
    that repeat a key included. They are told apart by ``_row``: the caller's own column of that name,
    which must be the same however often ``df`` is read and is then returned, too; without it ``df`` is
    written once, numbered.

    The vocabulary grows with the data, so the lookup is a join by word. The ``DICTIONARY_WORDS``
    most frequent words are looked up in a broadcast dictionary where the text is. Only the others
    are shuffled, once for each row that has them, and come back to the row's text with their ids."""
    keys = [key] if isinstance(key, str) else list(key)
    own = "_row" in df.columns
    d = df if own else df.withColumn("_row", F.monotonically_increasing_id())
    d = d.select("_row", *keys, F.make_valid_utf8(F.col(col).cast("string")).alias("_text"))
    if not own:
        from robustq.functions.materialize import materialize
        d = materialize(d)
    hot = df.sparkSession.sparkContext.broadcast(_dictionary(vocab))
    found = _rare_words(d, hot).join(vocab.select("token", F.col("token_id").cast("bigint")), "token") \
        .where(F.col("token_id").isNotNull()) \
        .groupBy("_row").agg(F.collect_list(F.struct("token", "token_id")).alias("_f")) \
        .select(F.col("_row").alias("_r"), F.col("_f.token").alias("_tokens"), F.col("_f.token_id").alias("_found"))
    e = d.join(found, F.col("_row") == F.col("_r"), "left").drop("_r")
    return _looked_up(e, hot, out).select(*(["_row"] if own else []), *keys, out)


# -- B11 ----------------------------------------------------------------------------
def truncate_head(df: DataFrame, col: str, max_len: int = MAX_SEQ) -> DataFrame:
    """Keep the last ``max_len`` tokens (tokens are dropped from the head)."""
    return df.withColumn(col, F.slice(F.col(col), F.greatest(F.size(col) - (max_len - 1), F.lit(1)), max_len))


# -- B13 ----------------------------------------------------------------------------
def epoch_batches(df: DataFrame, epochs: Sequence[int], size: int, max_batches: int | None = None,
                  key: str = "ex_id") -> DataFrame:
    """(epoch, batch, row...): per epoch shuffle by md5(epoch:key), cut into batches of
    ``size`` (last partial kept). All batches by default, numbered across all partitions
    (:func:`row_number_within`); with ``max_batches`` only the first ones, by a rank filter
    that becomes a per-task partial top-(size*max_batches) before the shuffle."""
    s = df.select(F.explode(F.array(*[F.lit(e) for e in epochs])).alias("epoch"), "*")
    if max_batches is None:
        s = s.withColumn("_h", hkey("epoch", key))
        rn = row_number_within(s.select("epoch", "_h", key), ["epoch"], ["_h", key], "_rn")
        s = s.drop("_h").join(rn.select("epoch", key, "_rn"), ["epoch", key])
    else:
        w = Window.partitionBy("epoch").orderBy(hkey("epoch", key), F.col(key))
        s = s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size * max_batches)
    return s.withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("bigint")).drop("_rn")


# -- B12 ----------------------------------------------------------------------------
def pad_batches(df: DataFrame, col: str, batch_cols: Sequence[str], pad: int = PAD_ID) -> DataFrame:
    """Pad ``col`` to the longest sequence of its batch (batches are bounded by the batch
    size) and add an attention mask (1 = real token)."""
    w = Window.partitionBy(*batch_cols)
    m = F.max(F.size(col)).over(w)
    d = df.withColumn("_m", m)
    fill = F.array_repeat(F.lit(pad).cast("bigint"), (F.col("_m") - F.size(col)).cast("int"))
    return (d.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(col)),
                                                    F.array_repeat(F.lit(0), (F.col("_m") - F.size(col)).cast("int"))))
            .withColumn(col, F.concat(F.col(col), fill)).drop("_m"))
