"""Queries F1-F8 (metrics and reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustq.functions.materialize import concurrently, materialize_all
from robustq.operators import metrics as mt
from robustq.operators.metrics import SQL_MEAN_PCT
from robustq.plans import experiments as ex
from robustq.plans import fixtures as fx
from robustq.plans import oracle_eval as oe
from robustq.plans.oracle_views import with_views
from robustq.plans.registry import register

BASE = ["v1", "v5t", "seeds", "labels_c"]
DEL = oe.experiment("d", "v1", oe.deletion_variants("v5t"), "docs")


def deletion_results(spark, sf):
    v1, trig = fx.grid_inputs(spark, sf)
    return ex.evaluate(v1, ex.ap_deletion_variants(trig), "docs", materialized=True)


@register("accuracy", with_views(BASE, "SELECT variant_id, acc, n_examples FROM d_acc", DEL))
def accuracy(spark, sf):
    """Σ correct / (n + 1e-13) per deletion variant."""
    v1, trig = fx.grid_inputs(spark, sf)
    preds = ex.predictions(v1, ex.ap_deletion_variants(trig), materialized=True)
    return mt.accuracy(preds, ["variant_id"])


@register("seed_mean", with_views(
    BASE, f"""SELECT exp_name, {SQL_MEAN_PCT.format(c='acc')} AS avg_acc, count(*) AS n_runs
             FROM (SELECT * FROM r_res UNION ALL SELECT * FROM o_res) u GROUP BY exp_name""",
    oe.experiment("r", "v1", oe.reorder_variants("v5t"), "docs")
    + oe.experiment("o", "v1", oe.original_variants("v5t"), "docs")))
def seed_mean(spark, sf):
    """mean of per-run accuracies x 100 for the reordering and original experiments
    (both grids scored in one pass: the variant tables are unioned)."""
    v1, trig = fx.grid_inputs(spark, sf)
    var = ex.ap_reorder_variants(trig).unionByName(ex.original_variants(trig))
    return mt.seed_mean(ex.evaluate(v1, var, "docs", materialized=True))


@register("deletion_report", with_views(BASE, f"""
    SELECT CAST(del_idx AS INTEGER) AS row_no, 'Single token deletion (idx=' || del_idx || ')' AS method,
           {SQL_MEAN_PCT.format(c='acc')} AS avg_acc
    FROM d_res WHERE n_del > 0 AND del_idx IN ('0','1','2','3','4','5','6','7','8','9') GROUP BY del_idx
    UNION ALL
    SELECT CAST(10 + list_position([1, 3, 5, 7], n_del) - 1 AS INTEGER),
           'Multiple token deletion (n=' || CAST(n_del AS VARCHAR) || ')', {SQL_MEAN_PCT.format(c='acc')}
    FROM d_res WHERE n_del IN (1, 3, 5, 7) GROUP BY n_del""", DEL))
def deletion_report(spark, sf):
    """the AP deletion report (14 rows)."""
    return mt.deletion_report(deletion_results(spark, sf))


_ADV_SETS = [("no_change", "ap-adv-label-no-change"), ("change", "ap-adv-label-change"), ("original", "ap-no-adv")]
_ADV_VAR = " UNION ALL ".join(
    f"SELECT *, '{s}' AS set FROM ({oe.original_variants('v5t', e)}) q{i}" for i, (s, e) in enumerate(_ADV_SETS))


@register("perturbation_report", with_views(
    BASE + ["v6"], f"""
    SELECT l.row_no, l.method, {SQL_MEAN_PCT.format(c='r.acc')} AS avg_acc
    FROM (VALUES (1, 'Perturbation w/o label changes', 'ap-adv-label-no-change'),
                 (2, 'Perturbation w/ label changes', 'ap-adv-label-change'),
                 (3, 'Original (no perturbation)', 'ap-no-adv')) AS l(row_no, method, exp_name)
    LEFT JOIN a_res r ON r.exp_name = l.exp_name GROUP BY l.row_no, l.method""",
    oe.experiment("a", "v6", _ADV_VAR, "docs", train="v1", key=("set", "ex_id"), on=("set",))))
def perturbation_report(spark, sf):
    """accuracy on the no-change, change and original sets (weights learnt on V1);
    the three sets are scored in one pass keyed by (set, ex_id)."""
    v1, trig = fx.grid_inputs(spark, sf)  # V1: training rows and the base of the three sets
    var = None
    for s, e in _ADV_SETS:
        v = ex.original_variants(trig, e).withColumn("set", F.lit(s))
        var = v if var is None else var.unionByName(v)
    res = ex.evaluate(fx.adversarial(v1), var, "docs", train=v1, on=("seed", "set"), key=("set", "ex_id"))
    return mt.perturbation_report(res)


@register("mp_deletion_report", with_views(
    BASE, f"""
    SELECT l.row_no, l.method, {SQL_MEAN_PCT.format(c='r.acc')} AS avg_acc
    FROM (VALUES (1, 'Single token deletion (idx=0)', '0', NULL), (2, 'Single token deletion (idx=1)', '1', NULL),
                 (3, 'Single token deletion (idx=2)', '2', NULL), (4, 'Multiple token deletion (n=1)', NULL, 1),
                 (5, 'Multiple token deletion (n=2)', NULL, 2), (6, 'Multiple token deletion (n=3)', NULL, 3),
                 (7, 'Multiple token deletion (one from front)', '0', NULL),
                 (8, 'Multiple token deletion (three from front)', '0-1-2', NULL),
                 (9, 'Multiple token deletion (one from back)', '2', NULL),
                 (10, 'Multiple token deletion (three from back)', '0-1-2', NULL)) AS l(row_no, method, del_idx, n_del)
    LEFT JOIN m_res r ON r.del_idx = l.del_idx OR r.n_del = l.n_del GROUP BY l.row_no, l.method""",
    oe.experiment("m", "v1", oe.mp_deletion_variants("v5t"), "docs", family="mp", eps=False)))
def mp_deletion_report(spark, sf):
    """the MP deletion report (10 rows) over the 7 blanking variants per seed."""
    v1, trig = fx.grid_inputs(spark, sf)
    var = ex.mp_deletion_variants(trig)
    return mt.mp_deletion_report(ex.evaluate(v1, var, "docs", family="mp", eps=None, materialized=True))


@register("running_loss", with_views(["v7"], """
    SELECT run, epoch, step, loss,
           round(avg(loss) OVER (PARTITION BY run, epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
             AS running_loss
    FROM v7"""))
def running_loss(spark, sf):
    """running mean loss reset every epoch (10 steps)."""
    return mt.running_mean(fx.step_log(spark, sf))


@register("best_checkpoint", with_views(["v7"], """
    SELECT run, epoch, step, loss FROM (
      SELECT *, max(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM v7) t
    WHERE loss > coalesce(prev, CAST('-inf' AS DOUBLE))"""))
def best_checkpoint(spark, sf):
    """steps whose metric strictly beats every earlier step of the run (start -inf)."""
    return mt.strict_best(fx.step_log(spark, sf), ["run"], "step", "loss", start=None)


@register("eval_schedule", with_views(["v7"], """
    SELECT run, step, CAST(floor(step / 12.5) AS BIGINT) AS epoch_no, round(cum, 6) AS avg_loss FROM (
      SELECT run, step, avg(loss) OVER (PARTITION BY run, (step - 1) // 13 ORDER BY step
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM v7) t
    WHERE step % 5 = 0"""))
def eval_schedule(spark, sf):
    """F8: evaluation every 5 steps; epoch = int(step / (200 rows / 16 per batch)); the
    average loss restarts with every pass of 13 batches."""
    return mt.eval_marks(fx.step_log(spark, sf), interval=5, rows=200, bsz=16)


# -- the MP family --------------------------------------------------------------------
_MPR = oe.experiment("mr", "v1", oe.mp_reorder_variants("v5t"), "docs", family="mp", eps=False)


@register("mp_reordering_report", with_views(BASE, f"""
    SELECT 'Reordering (random)' AS method, {SQL_MEAN_PCT.format(c='acc')} AS avg_acc FROM mr_res""", _MPR))
def mp_reordering_report(spark, sf):
    """F2 of the MP family: every other order of the manual prompt tokens."""
    v1, trig = fx.grid_inputs(spark, sf)
    res = ex.evaluate(v1, ex.mp_reorder_variants(trig), "docs", family="mp", eps=None, materialized=True)
    return mt.experiment_report(res, mt.REORDERING_ROW)


_MP_SETS = [("no_change", "mp-adv-label-no-change"), ("change", "mp-adv-label-change"), ("original", "mp-no-adv")]
_MP_VAR = " UNION ALL ".join(
    f"SELECT *, '{s}' AS set FROM ({oe.mp_original_variants('v5t', e)}) q{i}" for i, (s, e) in enumerate(_MP_SETS))


@register("mp_perturbation_report", with_views(
    BASE + ["v6"], f"""
    SELECT l.row_no, l.method, {SQL_MEAN_PCT.format(c='r.acc')} AS avg_acc
    FROM (VALUES (1, 'Perturbation w/o label changes', 'mp-adv-label-no-change'),
                 (2, 'Perturbation w/ label changes', 'mp-adv-label-change'),
                 (3, 'Original (no perturbation)', 'mp-no-adv')) AS l(row_no, method, exp_name)
    LEFT JOIN ma_res r ON r.exp_name = l.exp_name GROUP BY l.row_no, l.method""",
    oe.experiment("ma", "v6", _MP_VAR, "docs", family="mp", train="v1", key=("set", "ex_id"), on=("set",), eps=False)))
def mp_perturbation_report(spark, sf):
    """F4 of the MP family: the manual prompt on the three adversarial sets."""
    v1, trig = fx.grid_inputs(spark, sf)
    var = None
    for s, e in _MP_SETS:
        v = ex.mp_original_variants(trig, e).withColumn("set", F.lit(s))
        var = v if var is None else var.unionByName(v)
    res = ex.evaluate(fx.adversarial(v1), var, "docs", family="mp", train=v1, eps=None,
                      on=("seed", "set"), key=("set", "ex_id"))
    return mt.perturbation_report(res, family="mp")


@register("mp_cross_dataset", with_views(
    ["v1", "v2", "v5t", "seeds", "labels_c"], """
    SELECT exp_name, task, model, seed, dp, template, acc FROM (
      SELECT *, 200 AS dp FROM y1_res UNION ALL SELECT *, 200 FROM y2_res) u""",
    oe.experiment("y1", "v2", oe.mp_original_variants("v5t", "mp-cross-dataset"), "turns", family="mp", train="v1", eps=False)
    + oe.experiment("y2", "v1", oe.mp_original_variants("v5t", "mp-cross-dataset"), "docs", family="mp", train="v2", eps=False)))
def mp_cross_dataset(spark, sf):
    """D8 of the MP family, both directions, with the training size (dp) of each run."""
    v1, v2, trig = materialize_all(fx.docs_pairs(spark, sf), fx.turn_pairs(spark, sf), fx.triggers_plan(spark, sf))
    var = ex.mp_original_variants(trig, "mp-cross-dataset")
    to_turns, to_docs = concurrently(
        lambda: ex.evaluate(v2, var, "turns", family="mp", train=v1, eps=None),
        lambda: ex.evaluate(v1, var, "docs", family="mp", train=v2, eps=None))
    return ex.with_datapoints(to_turns.unionByName(to_docs)).select(
        "exp_name", "task", "model", "seed", "dp", "template", "acc")
