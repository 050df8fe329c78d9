"""The robustness experiments as Spark plans: variants x examples -> scores -> results.

One job per experiment instead of one model evaluation per variant: the variant table is
small and bounded by configuration (41 per seed for deletion), so it is broadcast; the
examples stream through a single scan, one per-(seed, example) score aggregation and a
per-variant partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustq.operators import perturb
from robustq.operators.metrics import accuracy
from robustq.operators.prompts import AP_TEMPLATE, MP_TEMPLATE, MP_TOKENS, fill_prompt, manual_template
from robustq.operators.scoring import TRAIN_ROWS, AdditiveScorer, predict_from_scores

MODEL = "additive"  # fixed value: name of the built-in scorer in result rows

VARIANT_COLS = ["seed", "variant_id", "exp_name", "method", "rep", "tokens", "del_idx", "n_del"]


def _finish(v: DataFrame, exp_name: str) -> DataFrame:
    for c, t in (("method", "string"), ("rep", "int"), ("del_idx", "string"), ("n_del", "int")):
        if c not in v.columns:
            v = v.withColumn(c, F.lit(None).cast(t) if c != "n_del" else F.lit(0))
    v = v.withColumn("exp_name", F.lit(exp_name))
    vid = F.concat_ws(":", F.col("exp_name"), F.col("seed").cast("string"), F.col("method"),
                      F.coalesce(F.col("rep").cast("string"), F.lit("-")),
                      F.col("n_del").cast("string"), F.coalesce(F.col("del_idx"), F.lit("n/a")))
    return v.withColumn("variant_id", vid).select(*VARIANT_COLS)


def ap_deletion_variants(triggers: DataFrame, exp_name: str = "ap-deletion") -> DataFrame:
    """D6 on the per-seed triggers (41 variants per seed)."""
    return _finish(perturb.deletion_grid(triggers, "tokens", ("seed",)), exp_name)


def ap_reorder_variants(triggers: DataFrame, exp_name: str = "ap-reordering") -> DataFrame:
    """D1 on the per-seed triggers (10 variants per seed)."""
    v = perturb.reorder_random(triggers, "tokens", ("seed",)).withColumn("method", F.lit("reorder"))
    return _finish(v, exp_name)


def original_variants(triggers: DataFrame, exp_name: str = "ap-original-acc") -> DataFrame:
    """The unperturbed trigger per seed."""
    v = triggers.withColumn("method", F.lit("original")).withColumn("rep", F.lit(0))
    return _finish(v, exp_name)


def mp_base(triggers: DataFrame) -> DataFrame:
    """The manual prompt tokens, one row per seed of the trigger table (the MP family
    fine-tunes one model per seed; the prompt itself is fixed)."""
    return triggers.select("seed", F.array(*[F.lit(t) for t in MP_TOKENS]).alias("tokens"))


def mp_deletion_variants(triggers: DataFrame, exp_name: str = "mp-deletion") -> DataFrame:
    """D5 on the 3 manual prompt tokens (7 variants per seed)."""
    v = perturb.delete_subsets(mp_base(triggers)).withColumn("method", F.lit("blank")) \
        .withColumn("rep", F.lit(0))
    return _finish(v, exp_name)


def mp_reorder_variants(triggers: DataFrame, exp_name: str = "mp-reordering") -> DataFrame:
    """D2 on the 3 manual prompt tokens (5 variants per seed)."""
    v = perturb.reorder_all(mp_base(triggers)).withColumn("method", F.lit("permute")) \
        .withColumnRenamed("perm_id", "rep")
    return _finish(v, exp_name)


def mp_original_variants(triggers: DataFrame, exp_name: str) -> DataFrame:
    """The manual prompt as it is, one row per seed."""
    v = mp_base(triggers).withColumn("method", F.lit("original")).withColumn("rep", F.lit(0))
    return _finish(v, exp_name)


def with_datapoints(results: DataFrame, dp: int = TRAIN_ROWS) -> DataFrame:
    """Result rows of the MP family also name the training size they were learnt from."""
    return results.withColumn("dp", F.lit(dp))


def template_col(family: str) -> F.Column:
    if family == "mp":
        return manual_template(F.col("tokens"), MP_TEMPLATE)
    return fill_prompt(F.lit(AP_TEMPLATE), F.col("tokens"))


def predictions(examples: DataFrame, variants: DataFrame, train: DataFrame | None = None,
                scorer: AdditiveScorer | None = None, on=("seed",), key=("ex_id",),
                materialized: bool = False, n_variants: int | None = None) -> DataFrame:
    """E8 + E2/E3: one row per (variant, example) with pred and correct.

    When the examples are also the training rows they are read twice (training sample and
    example scores); they are then materialised once (unless ``materialized`` says the
    caller has), so the source scan (the whole documents text column for V1) runs once."""
    from robustq.functions.materialize import materialize
    scorer = scorer or AdditiveScorer()
    if train is None and not materialized:
        examples = materialize(examples)
    grid = scorer.score_grid(examples, variants, train, on=on, key=key, n_variants=n_variants)
    return predict_from_scores(grid)


def evaluate(examples: DataFrame, variants: DataFrame, task: str, family: str = "ap",
             train: DataFrame | None = None, scorer: AdditiveScorer | None = None,
             eps: float | None = 1e-13, on=("seed",), key=("ex_id",),
             materialized: bool = False) -> DataFrame:
    """results(exp_name, task, model, seed, template, acc, del_idx, n_del, n_examples)."""
    from robustq.functions.materialize import rows_within
    n = variants.count()
    preds = predictions(examples, variants, train, scorer, on, key, materialized, n)
    acc = accuracy(preds.select("variant_id", "correct"), ["variant_id"], eps)
    v = variants.drop(*[c for c in on if c != "seed"]).withColumn("template", template_col(family))
    # one accuracy row per variant: broadcast as the build side within the limit
    side = F.broadcast(acc) if n <= rows_within(128) else acc
    return (v.join(side, "variant_id", "left")
            .select("exp_name", F.lit(task).alias("task"), F.lit(MODEL).alias("model"), "seed",
                    "template", F.coalesce(F.col("acc"), F.lit(0.0)).alias("acc"), "del_idx", "n_del",
                    F.coalesce(F.col("n_examples"), F.lit(0).cast("bigint")).alias("n_examples")))
