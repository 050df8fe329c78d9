"""Plan checks: the grid joins are broadcast hash joins on keys, nothing is a cartesian
product, and scans read only the columns they need."""

import pytest

import __spark_entry__ as entry
from robustq.plans import registry
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["deletion_report", "perturbation_report", "score_prompts", "cross_dataset"])
def test_grid_is_broadcast_hash_join(spark, key):
    p = plan(entry.queries()[key](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_no_cartesian_anywhere(spark):
    bad = []
    registry.load_all()
    for k, fn in registry.QUERIES.items():
        if k in ("stream_accuracy", "tsv_pairs", "summary_sink"):
            continue  # their result is the file they have written; the same grid is planned below
        p = plan(fn(spark, SF_SMALL))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(k)
    assert not bad, bad


def test_documents_scan_is_pruned(spark):
    df = entry.queries()["standardize_pairs"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    # documents has 5 columns; only doc_id and text are read
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_train_sample_uses_partial_topk(spark):
    from robustq.operators.scoring import train_sample
    from robustq.plans.fixtures import docs_pairs
    p = plan(train_sample(docs_pairs(spark, SF_SMALL)))
    assert "WindowGroupLimit" in p


def test_flagship_has_no_sort_merge_join(spark):
    # every join of the deletion report is against a bounded or counted table
    p = plan(entry.queries()["deletion_report"](spark, SF_SMALL))
    assert "SortMergeJoin" not in p


def test_spread_decides_without_running_the_plan(spark):
    """The spread decision reads the scan's split count only: deciding on a joined plan
    would run its shuffle stages once more just to count partitions."""
    from robustq.functions.materialize import spread
    scan = spark.range(0, 1000, 1, 1)                       # one split
    joined = scan.join(spark.range(0, 1000, 1, 4).repartition(3, "id"), "id")
    sc = spark.sparkContext
    sc.setJobGroup("spread-decision", "plan only")
    try:
        out = spread(joined, source=scan)
        assert list(sc.statusTracker().getJobIdsForGroup("spread-decision")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert "Repartition" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 1000


def test_grid_buckets_only_past_the_limit(spark):
    """The variant grid is a broadcast within the limit and a bucketed join beyond it."""
    from robustq.operators.scoring import AdditiveScorer
    from robustq.plans import experiments as ex
    from robustq.plans import fixtures as fx
    v1, trig = fx.grid_inputs(spark, SF_SMALL)
    var = ex.ap_deletion_variants(trig)
    normal = ex.predictions(v1, var, scorer=AdditiveScorer(), materialized=True)
    forced = ex.predictions(v1, var, scorer=AdditiveScorer(broadcast_max_rows=10), materialized=True)
    assert "xxhash64" not in plan(normal)
    assert "xxhash64" in plan(forced)


def test_large_label_tables_move_no_texts(spark, monkeypatch):
    """Labels are broadcast by their count, whatever the session's limit for files; beyond it the join
    shuffles and gives the same rows. The pairs themselves are not written: they hold every line twice."""
    from robustq.plans import fixtures as fx
    from robustq.plans import q_scoring
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for labelled in (True, False):
            d = fx.docs_pairs(spark, SF_SMALL, labelled)
            assert "SortMergeJoin" not in plan(d) and "BroadcastHashJoin" in plan(d)
            want = sorted(map(str, d.collect()))
            with monkeypatch.context() as m:
                m.setattr(fx, "rows_within", lambda row_bytes: 0)
                d = fx.docs_pairs(spark, SF_SMALL, labelled)
                assert "SortMergeJoin" in plan(d)
                assert sorted(map(str, d.collect())) == want
        grid = plan(q_scoring._grid(spark, SF_SMALL))
        assert "documents.parquet" in grid and "SortMergeJoin [doc_id" not in grid
        assert "Scan ExistingRDD[ex_id" not in grid
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
