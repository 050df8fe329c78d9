"""Metrics and reports (F). All are aggregations or windows over bounded partitions.

Doubles are rounded to 6 places at the output (never formatted to text inside a query).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPS = 1e-13  # fixed value: the AP accuracy denominator guard (empty -> 0)


def accuracy(preds: DataFrame, by: Sequence[str], eps: float | None = EPS) -> DataFrame:
    """Σ correct / (n + eps) per group (partial aggregation: one row per group and task
    crosses the shuffle). ``eps=None`` is the MP form Σ/n (error-free NULL on empty)."""
    n = F.count(F.lit(1))
    s = F.sum(F.col("correct").cast("int"))
    acc = s / (n + F.lit(eps)) if eps is not None else s / n
    return preds.groupBy(*by).agg(F.round(acc, 6).alias("acc"), n.alias("n_examples"))


def mean_pct(col: str = "acc") -> Column:
    """Aggregate: mean of 6-decimal accuracies x 100, rounded half-up to 6 decimals with
    exact integer arithmetic (sums of micro-units), so no engine's float rounding of a
    tie can change the reported value. NULL when there are no rows."""
    s = F.sum(F.round(F.col(col) * 1_000_000).cast("bigint"))
    n = F.count(col)
    return F.when(n > 0, F.floor((s * 200 + n) / (n * 2)) / 1_000_000)


SQL_MEAN_PCT = ("CASE WHEN count({c}) > 0 THEN CAST((sum(CAST(round({c} * 1000000) AS BIGINT)) * 200 + count({c}))"
                " // (count({c}) * 2) AS DOUBLE) / 1000000 END")


def seed_mean(results: DataFrame, by: Sequence[str] = ("exp_name",)) -> DataFrame:
    """mean of per-run accuracies x 100 (not pooled over examples)."""
    return results.groupBy(*by).agg(mean_pct("acc").alias("avg_acc"),
                                    F.count(F.lit(1)).alias("n_runs"))


def _label_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "row_no int, method string, del_idx string, n_del int")


def deletion_report(results: DataFrame, n_tokens: int = 10,
                    sizes: Sequence[int] = (1, 3, 5, 7)) -> DataFrame:
    """mean accuracy x 100 by single deleted index 0..n-1 and by number deleted
    (baseline n_del = 0 excluded): GROUPING SETS ((del_idx), (n_del))."""
    r = results.filter(F.col("n_del") > 0)
    g = (r.groupingSets([["del_idx"], ["n_del"]], "del_idx", "n_del")
         .agg(mean_pct("acc").alias("a"), F.grouping_id().alias("gid")))
    by_idx = (g.filter((F.col("gid") == 1) & (F.col("del_idx").isin([str(i) for i in range(n_tokens)])))
              .select((F.col("del_idx").cast("int")).alias("row_no"),
                      F.concat(F.lit("Single token deletion (idx="), F.col("del_idx"), F.lit(")")).alias("method"),
                      "a"))
    size_pos = F.array_position(F.array(*[F.lit(s) for s in sizes]), F.col("n_del"))
    by_n = (g.filter((F.col("gid") == 2) & F.col("n_del").isin(list(sizes)))
            .select((F.lit(n_tokens) + size_pos - 1).cast("int").alias("row_no"),
                    F.concat(F.lit("Multiple token deletion (n="), F.col("n_del").cast("string"), F.lit(")")).alias("method"),
                    "a"))
    return by_idx.unionByName(by_n).select("row_no", "method", F.col("a").alias("avg_acc"))


# fixed values: report rows of the perturbation report (exp_name suffix -> row label)
REORDERING_ROW = "Reordering (random)"
CROSS_ROW = "Accuracy on the other task"
PERTURBATION_ROWS = [
    (1, "Perturbation w/o label changes", "adv-label-no-change"),
    (2, "Perturbation w/ label changes", "adv-label-change"),
    (3, "Original (no perturbation)", "no-adv"),
]

# fixed values: MP deletion report rows (row, label, del_idx filter, n_del filter)
MP_DELETION_ROWS = [
    (1, "Single token deletion (idx=0)", "0", None),
    (2, "Single token deletion (idx=1)", "1", None),
    (3, "Single token deletion (idx=2)", "2", None),
    (4, "Multiple token deletion (n=1)", None, 1),
    (5, "Multiple token deletion (n=2)", None, 2),
    (6, "Multiple token deletion (n=3)", None, 3),
    (7, "Multiple token deletion (one from front)", "0", None),
    (8, "Multiple token deletion (three from front)", "0-1-2", None),
    (9, "Multiple token deletion (one from back)", "2", None),
    (10, "Multiple token deletion (three from back)", "0-1-2", None),
]


def perturbation_report(results: DataFrame, family: str = "ap") -> DataFrame:
    """mean accuracy x 100 per adversarial set, fixed three rows in order."""
    spark = results.sparkSession
    lab = spark.createDataFrame([(r, m, f"{family}-{s}") for r, m, s in PERTURBATION_ROWS],
                                "row_no int, method string, exp_name string")
    agg = results.groupBy("exp_name").agg(mean_pct("acc").alias("a"))
    return (lab.join(F.broadcast(agg), "exp_name", "left")  # one row per experiment
            .select("row_no", "method", F.col("a").alias("avg_acc")))


def experiment_report(results: DataFrame, method: str) -> DataFrame:
    """One-row report: mean accuracy x 100 over all runs of an experiment."""
    return results.groupBy(F.lit(method).alias("method")).agg(mean_pct("acc").alias("avg_acc"))


def mp_deletion_report(results: DataFrame) -> DataFrame:
    """the ten MP deletion rows; each row is a predicate over (del_idx, n_del)."""
    spark = results.sparkSession
    lab = _label_table(spark, MP_DELETION_ROWS)
    by_idx = results.groupBy("del_idx").agg(mean_pct("acc").alias("a"))
    by_n = results.groupBy("n_del").agg(mean_pct("acc").alias("a"))
    # the aggregates have one row per deletion pattern / count (bounded): broadcast them
    rows_idx = lab.filter(F.col("del_idx").isNotNull()).drop("n_del") \
        .join(F.broadcast(by_idx), "del_idx", "left").select("row_no", "method", "a")
    rows_n = lab.filter(F.col("n_del").isNotNull()).drop("del_idx") \
        .join(F.broadcast(by_n), "n_del", "left").select("row_no", "method", "a")
    return rows_idx.unionByName(rows_n).select("row_no", "method", F.col("a").alias("avg_acc"))


def running_mean(log: DataFrame, partition: Sequence[str] = ("run", "epoch"),
                 order: str = "step", value: str = "loss") -> DataFrame:
    """cumulative mean of ``value`` reset per partition (the reference's 'EMA' is a
    plain running mean). Partitions are epochs of a bounded number of steps."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("running_loss", F.round(F.avg(value).over(w), 6))


def dense_steps(log: DataFrame, partition: Sequence[str], order: str, name: str) -> DataFrame:
    """Number the rows of each partition 1, 2, ... along ``order`` (which must be unique
    within a partition), skew-safe: a hot partition is numbered across many tasks."""
    from robustq.functions.ranking import row_number_within
    return row_number_within(log, list(partition), [order], name)


def strict_best(log: DataFrame, partition: Sequence[str], order: str, metric: str,
                start: float | None = 0.0, block: int = 1024, fanout: int = 1024,
                dense: bool = True) -> DataFrame:
    """keep the rows whose metric strictly exceeds every earlier metric and ``start``
    (0 for probe/fine-tune, None = -inf for trigger search).

    ``order`` is a dense 1-based step; with ``dense=False`` it is any column unique within
    a partition (gaps allowed), and rows are numbered first. The running maximum is built in levels so a hot run
    never lands in one task: block maxima of ``block`` steps and superblock maxima of
    ``fanout`` blocks (partial aggregations); a prefix maximum over superblocks (one row
    each), then over the blocks inside a superblock (at most ``fanout`` rows), then over
    the steps inside a block (at most ``block`` rows)."""
    if not dense:
        numbered = dense_steps(log, partition, order, "_step")
        out = strict_best(numbered, partition, "_step", metric, start, block, fanout)
        return out.drop("_step")
    blk = F.floor((F.col(order) - 1) / block).cast("bigint")
    d = log.withColumn("_blk", blk).withColumn("_sup", F.floor(F.col("_blk") / fanout).cast("bigint"))
    bmax = d.groupBy(*partition, "_sup", "_blk").agg(F.max(metric).alias("_bm"))
    smax = bmax.groupBy(*partition, "_sup").agg(F.max("_bm").alias("_sm"))
    ws = Window.partitionBy(*partition).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    smax = smax.select(*partition, "_sup", F.max("_sm").over(ws).alias("_before_sup"))
    wb = Window.partitionBy(*partition, "_sup").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bmax = (bmax.select(*partition, "_sup", "_blk", F.max("_bm").over(wb).alias("_before_blk"))
            .join(smax, [*partition, "_sup"]))
    wi = Window.partitionBy(*partition, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.max(metric).over(wi)).join(bmax, [*partition, "_sup", "_blk"])
    floor = F.lit(start) if start is not None else F.lit(float("-inf"))
    best = F.greatest(*[F.coalesce(F.col(c), floor) for c in ("_before_sup", "_before_blk", "_inside")], floor)
    return (d.withColumn("_best", best).filter(F.col(metric) > F.col("_best"))
            .drop("_best", "_blk", "_sup", "_before_sup", "_before_blk", "_inside"))


def eval_marks(log: DataFrame, interval: int, rows: int, bsz: int, partition: Sequence[str] = ("run",),
               order: str = "step", value: str = "loss", iters: int | None = None,
               dense: bool = True) -> DataFrame:
    """F8: evaluation marks every ``interval`` global steps (1-based, dense) with epoch =
    int(step / (rows / bsz)) and the average loss of the data pass the mark falls in, up to
    the mark: the sum restarts with every pass of ceil(rows / bsz) steps. ``iters``: only the
    int(iters / (rows / bsz)) passes of the schedule are run.

    The window is one pass of one run, a set number of steps, so a hot run is spread. With
    ``dense=False``, ``order`` is any column unique within a partition: rows are numbered
    first."""
    if not dense:
        numbered = dense_steps(log.select(*partition, order, value), partition, order, "_step")
        return eval_marks(numbered.drop(order).withColumnRenamed("_step", order), interval, rows,
                          bsz, partition, order, value, iters)
    per_epoch, per_pass = rows / bsz, -(-rows // bsz)
    d = log.withColumn("_pass", F.floor((F.col(order) - 1) / per_pass).cast("bigint"))
    if iters is not None:
        d = d.filter(F.col("_pass") < int(iters / per_epoch))
    w = Window.partitionBy(*partition, "_pass").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_avg", F.avg(value).over(w)).filter(F.col(order) % interval == 0)
    return d.select(*partition, F.col(order).cast("bigint").alias(order),
                    F.floor(F.col(order) / F.lit(per_epoch)).cast("bigint").alias("epoch_no"),
                    F.round("_avg", 6).alias("avg_loss"))
