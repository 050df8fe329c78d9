"""Scoring (E): turn (example x prompt variant) into class scores, losses and predictions.

``AdditiveScorer`` is the built-in stand-in for a language model. It is a naive-Bayes
style table of integer log weights learnt per seed from a hash sample of the training
rows; its accuracies say nothing about any real model. It is *factorised*:

    score(variant, ex, y) = S_X(seed, ex, y) + S_T(variant, y)

S_X is computed once per (seed, example) and S_T once per variant, so the grid only ever
joins sums (examples x variants, one row per pair with an array of class scores) and never
examples x variants x tokens. A real model plugs in through :func:`score_with_model`
(Arrow batches via ``mapInPandas``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustq.functions.bind import bind
from robustq.functions.hashing import hkey
from robustq.functions.text import split_pieces, words

# fixed values
LABELS = ["entailment", "contradiction", "neutral"]  # class ids 0, 1, 2
SEEDS = [0, 1, 2, 3]
TRAIN_ROWS = 200          # few-shot training size per seed
SCALE = 1_000_000         # weights are integer micro-nats
MASKED = -1e32            # logit given to the masked pad token


def class_id(label: Column, labels: Sequence[str] = LABELS) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in labels]), label) - 1).cast("int")


def seeds_col(seeds: Sequence[int] = SEEDS) -> Column:
    return F.explode(F.array(*[F.lit(s) for s in seeds]))


def train_sample(examples: DataFrame, seeds: Sequence[int] = SEEDS, n: int = TRAIN_ROWS
                 ) -> DataFrame:
    """B5/B6-style per-seed sample of ``n`` rows: smallest md5(seed:ex_id). The ``rn <= n``
    filter becomes a per-task partial top-n (WindowGroupLimit) before the shuffle."""
    s = examples.select(seeds_col(seeds).alias("seed"), "*")
    w = Window.partitionBy("seed").orderBy(hkey("seed", "ex_id"), F.col("ex_id"))
    return s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


@dataclass(frozen=True)
class Fitted:
    """What one fit learnt: the materialised weights (token, w_<seed>...), the bound of their
    rows, and the weight of an unseen word per seed."""

    weights: DataFrame
    rows: int
    priors: dict[int, list[int]]


class AdditiveScorer:
    """Per-seed integer log weights w(f, y) = round(1e6 * ln((c(f,y) + 1) / (N_y + F)))."""

    def __init__(self, labels: Sequence[str] = LABELS, seeds: Sequence[int] = SEEDS,
                 train_rows: int = TRAIN_ROWS, broadcast_max_rows: int | None = None):
        from robustq.functions.materialize import rows_within
        self.labels = list(labels)
        self.seeds = list(seeds)
        self.train_rows = train_rows
        # a weight row: the token and one array of class weights per seed
        self.weight_rows = broadcast_max_rows or rows_within(64 + len(self.seeds) * (32 + 8 * len(self.labels)))
        # a variant row: its token array, names and class scores
        self.variant_rows = broadcast_max_rows or rows_within(1024)

    # -- fitting ----------------------------------------------------------------------
    def fit(self, examples: DataFrame, sample: bool = True) -> Fitted:
        """Learn from the training sample (``sample=False``: from the rows given, one row set
        per seed). The weights have one row per token seen in any seed's sample, ``w_<seed>``
        NULL where that seed never saw it; they and the priors are bounded by the training
        size, not by the data."""
        from robustq.functions.materialize import materialize
        tr = train_sample(examples, self.seeds, self.train_rows) if sample else examples
        k = len(self.labels)
        tw = tr.select("seed", class_id(F.col("label"), self.labels).alias("cid"),
                       F.explode(split_pieces(F.concat_ws(" ", "sentence_a", "sentence_b"))).alias("token")) \
            .filter(F.col("token") != "")
        # (seed, token) counts per class, written once: the totals and the weights below
        # both read them (bounded by the training sample, not the data)
        counts = materialize(tw.groupBy("seed", "token").agg(
            *[F.sum(F.when(F.col("cid") == i, 1).otherwise(0)).alias(f"c{i}") for i in range(k)]))
        # one row per seed: distinct tokens F and words per class N_y; the denominators
        # N_y + F become literals of the weight plan
        tot = counts.groupBy("seed").agg(F.count(F.lit(1)).alias("nf"),
                                         *[F.sum(f"c{i}").alias(f"n{i}") for i in range(k)]).collect()
        totals = {r["seed"]: [r[f"n{i}"] + r["nf"] for i in range(k)] for r in tot}

        def w(c: Column, i: int) -> Column:
            den = F.lit(None).cast("bigint")
            for sd, d in totals.items():
                den = F.when(F.col("seed") == sd, F.lit(d[i])).otherwise(den)
            return F.round(F.lit(float(SCALE)) * F.log((c + 1) / den)).cast("bigint")

        import math

        def w0(d: int) -> int:  # round half away from zero, as the weight expression does
            x = SCALE * math.log(1 / d)
            return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)

        long_w = counts.select("seed", "token", F.array(*[w(F.col(f"c{i}"), i) for i in range(k)]).alias("w"))
        # read by every scoring step (example side, variant side, search iterations):
        # written once
        wide = materialize(long_w.groupBy("token").agg(
            *[F.first(F.when(F.col("seed") == sd, F.col("w")), ignorenulls=True).alias(f"w_{sd}")
              for sd in self.seeds]))
        # one row per token of any seed: at most the sum of the per-seed distinct counts,
        # which is the size bound the broadcast check uses (no extra count job)
        return Fitted(wide, sum(r["nf"] for r in tot), {sd: [w0(d) for d in ds] for sd, ds in totals.items()})

    def _weights_side(self, fitted: Fitted) -> DataFrame:
        """Broadcast the weights only within the size bound; beyond it the lookup is a shuffle
        join with AQE skew splitting for hot tokens."""
        return F.broadcast(fitted.weights) if fitted.rows <= self.weight_rows else fitted.weights

    # -- factors ----------------------------------------------------------------------
    def example_scores(self, examples: DataFrame, fitted: Fitted,
                       key: Sequence[str] = ("ex_id",)) -> DataFrame:
        """(seed, *key, gold, s array<bigint>): Σ over every word of sentence_a and
        sentence_b of w(word, y), unseen words weighing w0(y).

        Each word is looked up once for all seeds (weights are one row per token), summed
        per example with a map-side partial aggregate, and only then fanned out to seeds."""
        k = len(self.labels)
        key = list(key)
        w0 = fitted.priors
        ex = examples.select(*key, F.col("label").alias("gold"),
                             F.explode_outer(words(F.concat_ws(" ", "sentence_a", "sentence_b"))).alias("token"))
        j = ex.join(self._weights_side(fitted), "token", "left")
        vals = []
        for sd in self.seeds:
            for i in range(k):
                v = F.coalesce(F.col(f"w_{sd}")[i], F.lit(w0[sd][i]).cast("bigint"))
                vals.append(F.sum(F.when(F.col("token").isNull(), F.lit(0).cast("bigint")).otherwise(v))
                            .alias(f"s{sd}_{i}"))
        agg = j.groupBy(*key, "gold").agg(*vals)
        per_seed = F.array(*[F.struct(F.lit(sd).alias("seed"),
                                      F.array(*[F.col(f"s{sd}_{i}") for i in range(k)]).alias("s"))
                             for sd in self.seeds])
        return agg.select(*key, "gold", F.explode(per_seed).alias("_x")) \
            .select(F.col("_x.seed").alias("seed"), *key, "gold", F.col("_x.s").alias("s"))

    def variant_scores(self, variants: DataFrame, fitted: Fitted, col: str = "tokens") -> DataFrame:
        """(variant_id, t array<bigint>): Σ_i (n - i) * w(t_i, y), i 0-based, n = number of
        tokens; empty tokens ('' from blanking) weigh 0."""
        k = len(self.labels)
        w0 = fitted.priors
        v = variants.select("seed", "variant_id", F.size(col).alias("n"),
                            F.posexplode_outer(col).alias("i", "token"))
        j = v.join(self._weights_side(fitted), "token", "left")
        w0_col = F.lit(None).cast("array<bigint>")
        seed_w = F.coalesce(*[F.when(F.col("seed") == sd, F.col(f"w_{sd}")) for sd in self.seeds])
        for sd in self.seeds:
            w0_col = F.when(F.col("seed") == sd, F.array(*[F.lit(x).cast("bigint") for x in w0[sd]])).otherwise(w0_col)
        factor = (F.col("n") - F.col("i")).cast("bigint")
        wv = F.when(F.col("token").isNull() | (F.col("token") == ""),
                    F.array(*[F.lit(0).cast("bigint")] * k)) \
            .otherwise(F.coalesce(seed_w, w0_col))
        j = j.select("variant_id", *[(wv[i] * factor).alias(f"t{i}") for i in range(k)])
        agg = j.groupBy("variant_id").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(k)])
        return agg.select("variant_id", F.array(*[F.coalesce(F.col(f"t{i}"), F.lit(0).cast("bigint"))
                                                  for i in range(k)]).alias("t"))

    # -- grid -------------------------------------------------------------------------
    def score_grid(self, examples: DataFrame, variants: DataFrame,
                   train: DataFrame | None = None, col: str = "tokens",
                   on: Sequence[str] = ("seed",), key: Sequence[str] = ("ex_id",),
                   n_variants: int | None = None) -> DataFrame:
        """(variant columns..., *key, gold, score array<bigint>) for every example x variant
        agreeing on ``on`` (the seed, plus e.g. the example set). ``variants`` is a bounded
        table (a few dozen rows per seed) and is broadcast; the example side streams."""
        fitted = self.fit(train if train is not None else examples)
        ex = self.example_scores(examples, fitted, key)
        return self.grid_from(ex, variants, fitted, col, on, n_variants)

    def grid_from(self, ex_scores: DataFrame, variants: DataFrame, fitted: Fitted,
                  col: str = "tokens", on: Sequence[str] = ("seed",),
                  n_variants: int | None = None) -> DataFrame:
        """Grid from precomputed example scores (reused across search iterations).

        The variant table is bounded by configuration (41 per seed for deletion) and is
        broadcast after a row count (cheap: it derives from a few checkpointed rows).
        Beyond the limit, variants are split into hash buckets and each example row is
        replicated once per bucket; the join on (``on``, bucket) then spreads the examples x
        variants product over at least the cluster's parallelism instead of one task per
        seed. ``n_variants``: a bound the caller has proven (e.g. rows it built on the
        driver), which saves the count."""
        vs = self.variant_scores(variants, fitted, col)
        vt = variants.join(vs, "variant_id")
        n = n_variants if n_variants is not None else variants.count()
        g = grid_join(ex_scores, vt, on, n, self.variant_rows)
        return g.withColumn("score", summed("s", "t", len(self.labels))).drop("s", "t")


def summed(s: str, t: str, k: int) -> Column:
    """The sums of two arrays of ``k`` class scores. Written out by class: a lambda would be
    interpreted for each of the examples x variants rows."""
    return F.array(*[F.get(F.col(s), i) + F.get(F.col(t), i) for i in range(k)])


def grid_join(examples: DataFrame, variants: DataFrame, on: Sequence[str], n_variants: int,
              max_rows: int) -> DataFrame:
    """Every example row with every variant agreeing on ``on``. Variants within
    ``max_rows`` are broadcast. Beyond it, variants are split into hash buckets of
    ``variant_id`` and each example row is replicated once per bucket, so the join on
    (``on``, bucket) spreads the product over at least the cluster's parallelism."""
    if n_variants <= max_rows:
        return examples.join(F.broadcast(variants), list(on))
    b = max(examples.sparkSession.sparkContext.defaultParallelism, -(-n_variants // max_rows))
    vb = variants.withColumn("_b", F.pmod(F.xxhash64("variant_id"), F.lit(b)).cast("int"))
    eb = examples.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    return eb.join(vb, [*on, "_b"]).drop("_b")


def predict_from_scores(grid: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """E2/E3 on class scores (higher = more likely): pred = argmax (ties -> lowest class id);
    correct iff the gold score is strictly the largest (a tie with gold counts as wrong)."""
    lab = F.array(*[F.lit(x) for x in labels])
    g = grid.withColumn("_gi", class_id(F.col("gold"), labels))
    gs = F.get(F.col("score"), F.col("_gi"))
    best = F.array_max("score")
    pred_i = F.array_position(F.col("score"), best) - 1
    # counted class by class, in compiled code (the grid has examples x variants rows)
    n_ge = sum((F.coalesce((F.get(F.col("score"), i) >= gs).cast("int"), F.lit(0)) for i in range(len(labels))), F.lit(0))
    return (g.withColumn("pred", F.get(lab, pred_i.cast("int")))
            .withColumn("correct", (n_ge <= 1) & gs.isNotNull())
            .drop("_gi"))


# ------------------------------------------------------------------------------------
# E1-E7 on logit vectors (V8): token d of a row has logit embedding[d].

def label_token_ids(n_labels: int = 10) -> Column:
    """Fixed label -> owned token ids of the V8 fixture: label c owns 3c+1..3c+3, except the
    last label, which owns 28, 29 and 0 (0 is the masked pad)."""
    owned = [[3 * c + 1, 3 * c + 2, 3 * c + 3] for c in range(n_labels - 1)] + [[28, 29, 0]]
    return F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in owned])


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array, shifted by its maximum."""
    return bind(values, lambda v: bind(F.array_max(v), lambda mx: mx + F.log(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx)))))


def _losses_of(labels: Column) -> Column:
    """Losses (in order) of the token lists ``labels`` for the logits in ``embedding``: the logits
    and their normaliser are evaluated once a row."""
    logits = F.transform("embedding", lambda x: x.cast("double"))

    def loss(lg: Column, lse: Column) -> Column:
        return F.transform(labels, lambda toks: -log_sum_exp(F.transform(
            toks, lambda t: F.when(t == 0, F.lit(MASKED)).otherwise(F.get(lg, t) - lse))))
    return bind(logits, lambda lg: bind(log_sum_exp(lg), lambda lse: loss(lg, lse)))


def class_losses(vectors: DataFrame, n_labels: int = 10) -> DataFrame:
    """(vec_id, gold, losses array<double>): E1 per class, row-local. The loss of a class is
    -logsumexp over its tokens of log_softmax(logits); the normaliser runs over all logits,
    and token 0 (the pad label) is masked to -1e32 only among the class's own tokens."""
    return vectors.select("vec_id", F.col("label").alias("gold"),
                          _losses_of(label_token_ids(n_labels)).alias("losses"))


def gold_losses(vectors: DataFrame, n_labels: int = 10) -> DataFrame:
    """(vec_id, gold, cls, loss): E1 for the gold class only (rows whose gold class is not one
    of the labels have no loss and are left out)."""
    gold = F.array(F.get(label_token_ids(n_labels), F.col("label").cast("int")))
    d = vectors.filter(F.col("label").between(0, n_labels - 1))
    return d.select("vec_id", F.col("label").alias("gold"), F.col("label").cast("int").alias("cls"),
                    F.get(_losses_of(gold), 0).alias("loss"))


def label_loss(vectors: DataFrame, n_labels: int = 10) -> DataFrame:
    """(vec_id, gold, cls, loss), one row per class."""
    return class_losses(vectors, n_labels).select("vec_id", "gold", F.posexplode("losses").alias("cls", "loss"))


def predict_label(losses: DataFrame, parity: bool = False) -> DataFrame:
    """Predicted class per example = argmin loss (ties -> lowest class), row-local over
    :func:`class_losses`. ``parity=True`` reproduces the reference quirk of taking the argmax
    of the loss."""
    best = F.array_max("losses") if parity else F.array_min("losses")
    return losses.select("vec_id", "gold", (F.array_position("losses", best) - 1).cast("int").alias("pred"))


def unique_min_correct(losses: DataFrame) -> DataFrame:
    """Correct iff #{classes with loss <= gold loss} <= 1 (a tie with gold is wrong),
    row-local over :func:`class_losses`."""
    gold_loss = F.get("losses", F.col("gold").cast("int"))
    n_le = F.size(F.filter("losses", lambda x: x <= gold_loss))
    return losses.select("vec_id", "gold", ((n_le <= 1) & gold_loss.isNotNull()).alias("correct"))


def gold_label_lookup(vectors: DataFrame, n_labels: int = 10) -> DataFrame:
    """Map each row's gold label-token id vector back to its label by exact array
    equality against the label table (an equi-join on the array column)."""
    table = label_token_ids(n_labels)
    lm = vectors.sparkSession.range(1).select(
        F.posexplode(table).alias("label_name", "ids"))  # 10-row label map
    gold_ids = vectors.select("vec_id", F.try_element_at(table, F.col("label") + 1).alias("ids"))
    j = gold_ids.join(F.broadcast(lm), "ids", "left")
    # every row must map back to a label (the reference asserts): fail the job otherwise
    name = F.when(F.col("label_name").isNull(),
                  F.raise_error(F.concat(F.lit("gold label ids match no label: vec_id "),
                                         F.col("vec_id").cast("string")))).otherwise(F.col("label_name"))
    return j.select("vec_id", name.cast("int").alias("label_name"))


def verbalizer_argmax(vectors: DataFrame, n_labels: int = 10) -> DataFrame:
    """E5 (manual verbalizer): class logit = mean of its label words' logits; argmax, ties to
    the lowest class id. No masking (the fine-tuned path has no pad label)."""
    lg = F.transform("embedding", lambda x: x.cast("double"))
    cl = F.transform(label_token_ids(n_labels),
                     lambda ts: F.aggregate(ts, F.lit(0.0), lambda a, t: a + F.get(lg, t)) / F.size(ts))
    d = vectors.select("vec_id", F.col("label").alias("gold"), cl.alias("cl"))
    pred = F.array_position("cl", F.array_max("cl")) - 1
    return d.select("vec_id", "gold", pred.cast("int").alias("pred"))


def negative_loss_metric(losses: DataFrame) -> DataFrame:
    """Without a label map the metric is -loss of the gold class (higher is better),
    averaged per gold class."""
    g = losses.filter(F.col("cls") == F.col("gold"))
    return g.groupBy("gold").agg(F.avg(-F.col("loss")).alias("metric"),
                                 F.count(F.lit(1)).alias("n"))


def sorted_seeds(variants: DataFrame) -> list[int]:
    """Seeds of a (bounded) variant table."""
    return sorted({r[0] for r in variants.select("seed").distinct().collect()})


def score_with_model(examples: DataFrame, variants: DataFrame, fn: Callable, schema: str,
                     max_rows: int | None = None) -> DataFrame:
    """E8 hook: score (example x variant) pairs with a user model in Arrow batches.

    ``fn(pdf) -> pdf`` receives pandas frames with the example and variant columns and must
    return ``schema`` (e.g. ``variant_id string, ex_id long, label string, logit double``).
    Variants are counted and broadcast within ``max_rows``, bucketed beyond it
    (:func:`grid_join`)."""
    from robustq.functions.materialize import rows_within
    if "seed" not in examples.columns:
        examples = examples.select(seeds_col(sorted_seeds(variants)).alias("seed"), "*")
    pairs = grid_join(examples, variants, ["seed"], variants.count(), max_rows or rows_within(1024))

    def run(it):
        for pdf in it:
            yield fn(pdf)

    return pairs.mapInPandas(run, schema)
