"""Steps of the grids that are written out in compiled code, and events packed per example."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from robustq.operators import inference as inf
from robustq.operators import perturb, scoring
from robustq.plans import q_prompts
from robustq.streaming import accuracy as sa
from robustq.streaming.accuracy import ANSWERS_SCHEMA, pack_answers, run_available


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grid_scores_and_predictions_without_lambdas(spark):
    rows = [("e", [1, 2, 3], "neutral"), ("t", [3, 1, 3], "neutral"), ("u", [5, 1, 1], None), ("x", [5, 1, 1], "other")]
    d = spark.createDataFrame(rows, "ex_id string, s array<bigint>, gold string").withColumn(
        "t", F.array(*[F.lit(x).cast("bigint") for x in (0, 1, 0)]))
    d = scoring.predict_from_scores(d.withColumn("score", scoring.summed("s", "t", 3)))
    assert "lambdafunction" not in plan(d)
    assert {r.ex_id: (r.score, r.pred, r.correct) for r in d.collect()} == {
        "e": ([1, 3, 3], "contradiction", False), "t": ([3, 2, 3], "entailment", False),
        "u": ([5, 2, 1], "entailment", False), "x": ([5, 2, 1], "entailment", False)}


def test_subsets_of_short_and_long_rows(spark):
    tokens = {n: [f"w{i}" for i in range(n)] for n in (1, 3, 4, 5, 6)}
    tokens[3][1] = None
    df = spark.createDataFrame(list(tokens.items()), "n int, tokens array<string>")
    got = {(r.n, r.del_idx): (r.tokens, r.n_del) for r in perturb.delete_subsets(df).collect()}
    want = {(n, "-".join(map(str, c))): (["" if i in c else x for i, x in enumerate(t)], k)
            for n, t in tokens.items() for k in range(1, n + 1) for c in itertools.combinations(range(n), k)}
    assert got == want
    assert "THEN slice(array(CASE" in plan(perturb.delete_subsets(df))


def test_slots_together_apart_none_and_too_many(spark):
    rows = [(0, ["a", "[T]", "[T]", "b"]), (1, ["[T]", "a", None, "[T]"]), (2, ["a"]), (3, ["[T]"] * 4), (4, []), (5, None),
            (6, ["[T]"])]
    d = spark.createDataFrame(rows, "n int, tokens array<string>").withColumn("trig", F.array(*map(F.lit, "xyz")))
    assert {r.n: r.tokens for r in q_prompts.scatter(d).collect()} == {
        0: ["a", "x", "y", "b"], 1: ["x", "a", None, "y"], 2: ["a"], 3: ["[T]"] * 4, 4: [], 5: None, 6: ["x"]}


def test_padded_rows_and_bag():
    flat, starts, n = np.arange(10), np.array([4, 0, 9]), np.array([3, 0, 1])
    got = inf.padded_rows(flat, starts, n)
    assert got.tolist() == [[4, 5, 6], [-1] * 3, [9, -1, -1]]
    w = np.random.default_rng(0).normal(size=(2, 11))
    np.testing.assert_allclose(inf.HashedBag(w)(got), [w[:, 4:7].mean(1) + w[:, 10], w[:, 10], w[:, 9] + w[:, 10]])


def test_answers_travel_as_one_event_per_example(spark, tmp_path):
    """The state holds a key per seed and example, delivered twice and late as in the query."""
    rows = [(v, s, e, "neutral", (i + s) % 3 == 0) for i, (v, s, e) in enumerate(
        (f"{s}:{v}", s, f"e{e}") for s in (0, 1) for v in range(5) for e in range(7))]
    preds = spark.createDataFrame(rows, "variant_id string, seed int, ex_id string, gold string, correct boolean")
    packed = pack_answers(preds, F.lit(dt.datetime(2024, 1, 2)).alias("event_time"))
    assert packed.count() == 14
    late = packed.withColumn("event_time", F.lit(dt.datetime(2024, 1, 1))).withColumn("ex_id", F.concat(F.lit("late"), "ex_id"))
    for batch in (packed, packed, late):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), ["variant_id"],
                            ANSWERS_SCHEMA, files_per_batch=9, delay="1 hour")
    want = {}
    for v, _, _, _, c in rows:
        want[v] = tuple(map(sum, zip(want.get(v, (0, 0)), (int(c), 1))))
    assert {r["variant_id"]: (r["n_correct"], r["n_examples"]) for r in out.collect()} == want


def test_answers_are_bits_and_no_lists(spark):
    """130 variants a seed (three numbers of 64 bits), some not asked, names with quotes and line breaks."""
    rows = [(f'{s}"{v}\n', s, f"e{e}", None if e == 2 else "neutral", (v * 7 + e + s) % 3 == 0)
            for s in (0, 1) for v in range(130) for e in range(4) if (v + e) % 5]
    preds = spark.createDataFrame(rows, "variant_id string, seed int, ex_id string, gold string, correct boolean")
    packed = pack_answers(preds, F.lit(dt.datetime(2024, 1, 2)).alias("event_time"))
    # lists of answers were sorted, and spilt, by the examples x variants
    assert "collect_list" not in plan(packed) and "ObjectHashAggregate" not in packed._jdf.queryExecution().executedPlan().toString()
    assert packed.schema.names == ANSWERS_SCHEMA.names
    assert packed.count() == 8 and {len(r["asked"]) for r in packed.collect()} == {3}
    lists = sa.variant_lists(packed)
    stream = packed.withColumn("list", F.xxhash64("variants")).drop("variants")
    got = stream.select("ex_id", "list", "asked", "correct")
    out = sorted((e, r["variant_id"], r["correct"]) for e in ("e0", "e1", "e2", "e3")
                 for r in sa.unpack_answers(got.where(F.col("ex_id") == e), lists).collect())
    assert out == sorted((e, v, c) for v, _, e, _, c in rows)
    with pytest.raises(Exception, match="unknown list of variants"):
        sa.unpack_answers(got, lists.limit(0)).collect()


def test_stream_shuffles_no_names(spark, tmp_path, monkeypatch):
    """What is told apart holds the hash of the list of variants, not the list."""
    seen = []
    first = sa.first_predictions
    monkeypatch.setattr(sa, "first_predictions", lambda s, *a: seen.append(s.columns) or first(s, *a))
    preds = spark.createDataFrame([("v", 0, "e", "neutral", True), ("w", 0, "e", "neutral", False)],
                                  "variant_id string, seed int, ex_id string, gold string, correct boolean")
    pack_answers(preds, F.lit(dt.datetime(2024, 1, 2)).alias("event_time")).write.parquet(str(tmp_path / "in"))
    out = run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), ["variant_id"],
                        ANSWERS_SCHEMA, files_per_batch=9, delay="1 hour")
    assert sorted((r["variant_id"], r["n_correct"], r["n_examples"]) for r in out.collect()) == [("v", 1, 1), ("w", 0, 1)]
    assert seen == [["seed", "ex_id", "asked", "correct", "event_time", "list"]]
