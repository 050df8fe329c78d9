"""Pairing perturbed rows with the original whose text is nearest.

A text pairs with the original at the smallest edit distance within ``share`` of its length (ties:
the smallest key). Equal texts pair by equality. For the others the q-gram prefix filter finds all
candidates without comparing all pairs: k edits touch at most k * q of a text's q-grams, so in
any fixed order of q-grams two texts within k edits share one of the first k * q + 1 of each. The
order puts frequent q-grams last - those that make up ``HOT_SHARE`` of all occurrences, of which
there can be 1 / ``HOT_SHARE`` at most, found by a pre-aggregated count and broadcast - so no common
q-gram becomes a bucket. Candidates of about equal length are verified by the edit distance
itself. Texts are compared once each, however many rows hold them.

Defined cases: null texts pair with nothing; a text too short for the filter is allowed fewer edits
(at most (length - q) / q); repeated rows pair alike; an empty side gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustq.functions.materialize import materialize

# parameters
Q = 5
SHARE = 0.1          # largest edit distance by the length of the perturbed text
HOT_SHARE = 1e-4


def edits_allowed(length: Column, q: int = Q, share: float = SHARE) -> Column:
    return F.greatest(F.least(F.floor(length * share), F.floor((length - q) / q)), F.lit(0)).cast("int")


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """(id, g): the q-grams of each text, repeats numbered, as 64-bit hashes. (Two q-grams with
    one hash only add a candidate.)"""
    at = F.when(F.length("t") >= q, F.sequence(F.lit(1), F.length("t") - (q - 1))).otherwise(F.array().cast("array<int>"))
    g = texts.select("id", F.posexplode(F.transform(at, lambda i: F.substring("t", i, F.lit(q)))).alias("pos", "gram"))
    w = Window.partitionBy("id", "gram").orderBy("pos")  # the repeats of one gram in one text
    return g.select("id", F.xxhash64("gram", F.row_number().over(w)).alias("g"))


def _prefixes(grams: DataFrame, texts: DataFrame, hot: DataFrame) -> DataFrame:
    """The first ``n`` grams of every text, rare ones before frequent ones."""
    j = grams.join(F.broadcast(hot), "g", "left")  # < 1 / HOT_SHARE rows
    w = Window.partitionBy("id").orderBy(F.coalesce("freq", F.lit(0)), "g")  # the grams of one text
    d = j.withColumn("rn", F.row_number().over(w))
    return d.join(texts.select("id", "n", "len"), "id").filter(F.col("rn") <= F.col("n")).select("id", "g", "len")


def nearest_texts(originals: DataFrame, perturbed: DataFrame, q: int = Q, share: float = SHARE) -> DataFrame:
    """Distinct texts (t, key) and (t) -> (t, key, distance): for each perturbed text with an original
    within its allowed distance, the nearest one."""
    same = perturbed.join(originals, "t").select("t", "key", F.lit(0).alias("distance"))
    length = F.length("t")
    # an original must show the grams that the longest text it could pair with needs
    a = materialize(originals.filter(length >= q).select(
        F.xxhash64(F.lit("a"), "t").alias("id"), "t", "key", length.alias("len"),
        (F.floor(length * (share / (1 - share))) * q + 1).cast("int").alias("n")))
    k = edits_allowed(length, q, share)
    b = materialize(perturbed.join(originals, "t", "left_anti").filter(k > 0).select(
        F.xxhash64(F.lit("b"), "t").alias("id"), "t", length.alias("len"), (k * q + 1).alias("n"), k.alias("k")))
    ga, gb = _grams(a, q), _grams(b, q)
    freq = materialize(ga.select("g").unionByName(gb.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("freq")))
    total = freq.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("n")).first()["n"]
    hot = materialize(freq.filter(F.col("freq") > F.lit(total * HOT_SHARE)))
    pa = _prefixes(ga, a, hot).select(F.col("id").alias("ia"), "g", F.col("len").alias("la"))
    pb = _prefixes(gb, b, hot).select(F.col("id").alias("ib"), "g", F.col("len").alias("lb"))
    limit = edits_allowed(F.col("lb"), q, share)
    cand = pb.join(pa, "g").filter(F.abs(F.col("la") - F.col("lb")) <= limit).select("ia", "ib").distinct()
    pairs = (cand.join(a.select(F.col("id").alias("ia"), F.col("t").alias("ta"), "key"), "ia")
             .join(b.select(F.col("id").alias("ib"), F.col("t").alias("tb"), "k"), "ib"))
    # with a threshold only a band of the matrix is computed; -1 beyond it
    near = pairs.withColumn("distance", F.expr("levenshtein(ta, tb, k)")).filter(F.col("distance") >= 0)
    best = near.groupBy("tb").agg(F.min(F.struct("distance", "key")).alias("m"))
    return same.unionByName(best.select(F.col("tb").alias("t"), "m.key", "m.distance"))


def pair_near(orig: DataFrame, pert: DataFrame, text: str, key: str, q: int = Q,
              share: float = SHARE) -> DataFrame:
    """The rows of ``pert`` with ``orig_key`` and ``distance`` of the nearest original (null where none
    is near enough). Of originals with one text the smallest key stands for all."""
    a = orig.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.min(key).alias("key"))
    a = materialize(a)
    b = pert.filter(F.col(text).isNotNull()).select(F.col(text).alias("t")).distinct()
    found = nearest_texts(a, b, q, share).select(F.col("t").alias("_t"), F.col("key").alias("orig_key"), "distance")
    return pert.join(found, F.col(text) == F.col("_t"), "left").drop("_t")
