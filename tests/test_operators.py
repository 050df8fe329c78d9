"""Unit and property tests on hand-made inputs (SURVEY 5: traps T1-T4, T9, T17, empty input,
one-token triggers, ties; the properties of the perturbation grids)."""

import itertools
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from robustq.functions.ranking import global_position, next_row, row_number_within
from robustq.operators import metrics as mt
from robustq.operators import perturb, prepare, prompts, scoring
from robustq.operators import search as se


def toks(spark, rows):
    return spark.createDataFrame(rows, "seed int, tokens array<string>")


# -- D: perturbation grids ------------------------------------------------------------
def test_deletion_grid_41_per_seed(spark):
    t = toks(spark, [(s, [f"w{i}" for i in range(10)]) for s in range(4)])
    g = perturb.deletion_grid(t).collect()
    assert len(g) == 164
    for r in g:
        assert len(r.tokens) + r.n_del == 10
        if r.del_idx:
            assert len(set(r.del_idx.split("-"))) == r.n_del
            kept = [f"w{i}" for i in range(10) if str(i) not in r.del_idx.split("-")]
            assert r.tokens == kept  # order kept
    assert {r.n_del for r in g} == {0, 1, 3, 5, 7}


def test_delete_random_draw_order_is_deterministic(spark):
    t = toks(spark, [(0, list("abcdefghij"))])
    a = [tuple(r) for r in perturb.delete_random(t).orderBy("rep", "n_del").collect()]
    b = [tuple(r) for r in perturb.delete_random(t.repartition(3)).orderBy("rep", "n_del").collect()]
    assert a == b


def test_reorder_all_is_all_nonidentity_permutations(spark):
    t = toks(spark, [(0, ["?", "|", ","]), (1, ["a", "b"]), (2, ["x"]), (3, [])])
    out = perturb.reorder_all(t).collect()
    three = {tuple(r.tokens) for r in out if r.seed == 0}
    assert len(three) == math.factorial(3) - 1
    assert three == set(itertools.permutations(["?", "|", ","])) - {("?", "|", ",")}
    assert [r.tokens for r in out if r.seed == 1] == [["b", "a"]]
    assert not [r for r in out if r.seed in (2, 3)]


def test_delete_subsets_keeps_slots(spark):
    t = toks(spark, [(0, ["?", "|", ","])])
    out = perturb.delete_subsets(t).collect()
    assert len(out) == 2 ** 3 - 1
    assert all(len(r.tokens) == 3 for r in out)  # T17: blanked, not removed
    by = {r.del_idx: r.tokens for r in out}
    assert by["0-2"] == ["", "|", ""]
    assert by["0-1-2"] == ["", "", ""]


def test_reorder_random_is_a_permutation(spark):
    t = toks(spark, [(s, list("abcdefghij")) for s in range(4)])
    for r in perturb.reorder_random(t).collect():
        assert sorted(r.tokens) == list("abcdefghij")


def test_one_token_trigger(spark):
    t = toks(spark, [(0, ["only"])])
    g = perturb.deletion_grid(t).collect()
    # the only token can be deleted: the variants are empty and say how many tokens went
    assert {(r.method, r.del_idx, r.n_del, len(r.tokens)) for r in g} == {
        ("original", None, 0, 1), ("single", "0", 1, 0), ("multiple", "0", 1, 0)}


def test_reorder_all_of_any_length(spark):
    import itertools
    for n in (1, 2, 4, 6):
        t = [chr(97 + i) for i in range(n)]
        got = [(r.perm_id, tuple(r.tokens)) for r in perturb.reorder_all(toks(spark, [(0, t)])).collect()]
        assert sorted(got) == list(enumerate(itertools.permutations(t)))[1:]


def test_pairs_are_all_consecutive_lines(spark):
    """The pair count equals the count taken from the raw table."""
    from robustq.plans import fixtures as fx
    from tests.conftest import SF_SMALL
    texts = [(r["doc_id"], r["text"]) for r in
             spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    n = {d: max(0, sum(1 for x in (t or "").split("\n") if x.strip(" \t\r")) - 1) for d, t in texts}
    every = fx.docs_pairs(spark, SF_SMALL, labelled=False)
    assert every.count() == sum(n.values()) == every.select("ex_id").distinct().count()
    assert fx.docs_pairs(spark, SF_SMALL).count() == sum(v for d, v in n.items() if d in labelled)


def test_turn_pairs_of_long_conversations_have_own_keys(spark, tmp_path):
    from robustq.plans import fixtures as fx
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t}") for c in range(3) for t in range(150)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .write.parquet(str(tmp_path / "conversations.parquet"))
    v2 = fx.turn_pairs(spark, str(tmp_path))
    assert v2.count() == v2.select("ex_id").distinct().count() == 3 * 75 + 3 * 74 + 2


def test_row_numbers_never_meet_by_group(spark):
    """With broadcasts off, no join on the group alone feeds the numbering: a hot run stays
    with the partitions that sorted it."""
    from robustq.functions.ranking import row_number_within
    log = spark.range(1000).selectExpr("if(id < 900, 0, id) as run", "id as ev", "id * 2 as x").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = row_number_within(log, ["run"], ["ev"], "rn")
        p = d._jdf.queryExecution().executedPlan().toString()
        rows = {(r.run, r.ev): r.rn for r in d.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [rows[(0, i)] for i in range(900)] == list(range(1, 901)) and rows[(950, 950)] == 1
    joins = [x for x in p.splitlines() if "SortMergeJoin" in x]
    # by (sort partition, run) and by the row key; by the run alone only the small start table
    assert sum("[run#" in x and "_pid" not in x and "ev#" not in x for x in joins) == 1


# -- C: prompts -----------------------------------------------------------------------
def test_fill_prompt_surplus_rules(spark):
    df = spark.createDataFrame([("a [T] b [T] c", ["x"]), ("[T] [T]", ["x", "y", "z"]), ("[T]", ["t[T]"])],
                               "tmpl string, tokens array<string>")
    out = [r[0] for r in df.select(prompts.fill_slots(F.col("tmpl"), F.col("tokens"))).collect()]
    assert out == ["a x b [T] c", "x y", "t[T]"]


def test_render_keeps_braces_in_data(spark):
    df = spark.createDataFrame([(1, "{sentence_B}", "b")], "ex_id long, sentence_a string, sentence_b string")
    r = prompts.render_pairs(df, prompts.AP_TEMPLATE).first().rendered
    assert r == "<s> {sentence_B} [P] [T] b </s>"


# -- E: scoring -----------------------------------------------------------------------
def test_tie_with_gold_is_wrong_and_argmax_ties_low(spark):
    g = spark.createDataFrame([(1, "entailment", [5, 5, 1]), (2, "contradiction", [1, 7, 3]),
                               (3, "neutral", [0, 0, 0]), (4, "other", [1, 2, 3])],
                              "ex_id long, gold string, score array<bigint>")
    out = {r.ex_id: (r.pred, r.correct) for r in scoring.predict_from_scores(g).collect()}
    assert out[1] == ("entailment", False)   # T3: tie with gold counts as wrong
    assert out[2] == ("contradiction", True)
    assert out[3] == ("entailment", False)   # all tied: lowest class, wrong
    assert out[4][1] is False                # unknown gold never correct


def _vec(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_pad_token_never_scores(spark):
    # token 0 has a huge logit but is masked (T4): label 9 owns 28, 29 and the pad 0
    e = [0.0] * 64
    e[0] = 50.0
    losses = scoring.label_loss(_vec(spark, [(0, e, 9)])).collect()
    l9 = [r.loss for r in losses if r.cls == 9][0]
    others = [r.loss for r in losses if r.cls != 9]
    assert abs(l9 - min(others)) < 1e-6 or l9 > min(others) - 1e-6
    assert all(math.isfinite(r.loss) for r in losses)


def test_predict_parity_flag(spark):
    e = [0.0] * 64
    e[1] = e[2] = e[3] = 5.0  # class 0 most likely
    l = scoring.class_losses(_vec(spark, [(0, e, 0)]))
    assert scoring.predict_label(l).first().pred == 0
    assert scoring.predict_label(l, parity=True).first().pred != 0  # T1: reference quirk
    assert scoring.unique_min_correct(l).first().correct is True


def test_losses_by_hand(spark):
    """The normaliser runs over all logits, the pad token too; only a label's own pad token
    is masked."""
    import math
    e = [50.0] + [0.0] * 63
    loss = {r.cls: r.loss for r in scoring.label_loss(_vec(spark, [(0, e, 0)])).collect()}
    lse = 50 + math.log(1 + 63 * math.exp(-50))
    assert round(loss[0], 4) == 48.9014 == round(lse - math.log(3), 4)
    assert round(loss[9], 6) == round(lse - math.log(2), 6)  # two tokens and the masked pad
    m = scoring.negative_loss_metric(scoring.label_loss(_vec(spark, [(0, e, 0)]))).first()
    assert round(m.metric, 4) == -48.9014 and m.n == 1


def test_eval_schedule_restarts_every_pass(spark):
    # 32 rows in batches of 10: passes of 4 steps, 3.2 batches an epoch
    log = spark.createDataFrame([(1, i, float(i)) for i in range(1, 11)], "run long, step long, loss double")
    got = [(r.step, r.epoch_no, r.avg_loss) for r in mt.eval_marks(log, 2, 32, 10).orderBy("step").collect()]
    assert got == [(2, 0, 1.5), (4, 1, 2.5), (6, 1, 5.5), (8, 2, 6.5), (10, 3, 9.5)]
    assert mt.eval_marks(log, 2, 32, 10, iters=7).count() == 4  # int(7 / 3.2) = 2 passes


def test_bad_facts_and_null_labels(spark):
    f = spark.createDataFrame([("s", "o", [("x", "[MASK] a")]), ("t", "o", []), ("u", "o", None)],
                              "sub_label string, obj_label string, "
                              "evidences array<struct<obj_surface string, masked_sentence string>>")
    ok, bad = prepare.split_facts(f)
    assert [r.sub_label for r in ok.collect()] == ["s"]
    assert {(r.sub_label, r.reason) for r in bad.collect()} == {("t", "no_evidences"), ("u", "no_evidences")}
    d = spark.createDataFrame([(1, "neutral"), (2, None)], "ex_id long, label string")
    assert prepare.require_label(d.filter("ex_id = 1")).first().label == "neutral"
    with pytest.raises(Exception, match="has no label"):
        prepare.require_label(d).collect()


def test_split_resolution(spark):
    from robustq.plans.q_sources import manifest_rows
    from robustq.sources.io import resolve_split
    man = spark.createDataFrame(manifest_rows(), "family string, task string, eval_type string, ds string")
    assert resolve_split(man, "ap", "docs", "cross_dataset") == "turns"
    assert resolve_split(man, "mp", "turns", "token_deletion") == "turns"
    for bad in (("ap", "docs", "nothing"), ("mp", "docs", "original-acc"), ("ap", "cb", "cross_dataset")):
        with pytest.raises(ValueError):
            resolve_split(man, *bad)


def test_cluster_needs_a_shared_folder():
    from robustq import session

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_gradient_candidates_rank_the_vocabulary(spark):
    ex = spark.createDataFrame([(i, "good fine", "x", "entailment") for i in range(4)]
                               + [(9, "bad", "x", "neutral")],
                               "ex_id long, sentence_a string, sentence_b string, label string")
    sc = scoring.AdditiveScorer()
    fitted = sc.fit(ex)
    allowed = spark.createDataFrame([(t,) for t in ("bad", "good", "fine", "new1", "new0", "zz")], "token string")
    space = se.search_space(fitted, allowed, sc.seeds, 2)
    # more entailment examples than predictions of it: words of that class gain most
    got = se.gradient_candidates(space, {0: [3, 0, -3]}, fitted.priors, 3).orderBy("cand_rank").collect()
    assert [r.token for r in got][:2] == ["fine", "good"] and len(got) == 3
    back = se.gradient_candidates(space, {0: [-3, 0, 3]}, fitted.priors, 1).collect()
    assert [r.token for r in back] == ["bad"]


def test_softmax_fit_lowers_the_loss(spark):
    import math
    rows = [(i, [float(i % 2), 1.0 - i % 2], i % 2) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    w = se.fit_softmax(v, [0, 1], 2, steps=40, rate=1.0)

    def p(x, y):
        lg = [sum(a * b for a, b in zip(r, [*x, 1.0])) for r in w]
        return math.exp(lg[y]) / sum(map(math.exp, lg))
    assert all(p(x, y) > 0.9 for _, x, y in rows)
    one = se.fit_softmax(v, [0, 1], 2, steps=1, rate=1.0)
    assert one[0] == pytest.approx([-0.25, 0.25, 0.0]) and one[1] == pytest.approx([0.25, -0.25, 0.0])


def test_full_fits_run_all_steps(spark, monkeypatch):
    import inspect

    import numpy as np

    import __spark_entry__ as entry
    from robustq.plans import fixtures as fx
    from robustq.plans import q_search as qs
    from tests.conftest import SF_SMALL
    steps = inspect.signature(se.fit_projection).parameters["steps"].default
    assert steps == inspect.signature(se.linear_probe).parameters["steps"].default > qs.FIT_STEPS
    got = {r["cls"]: [*r["weights"], r["intercept"]]
           for r in entry.queries()["label_projection_full"](spark, SF_SMALL).collect()}
    rows = fx.vectors(spark, SF_SMALL).select("embedding", "label").collect()
    x = np.array([[*r["embedding"], 1.0] for r in rows])
    y = np.eye(len(qs.CLASSES))[[r["label"] for r in rows]]
    w = np.zeros((len(qs.CLASSES), x.shape[1]))
    for _ in range(steps):
        e = np.exp(x @ w.T)
        w -= qs.RATE * (e / e.sum(1, keepdims=True) - y).T @ x / len(x)
    assert np.allclose([got[c] for c in qs.CLASSES], w, atol=2e-6)

    ran, fit = [], se.fit_softmax
    monkeypatch.setattr(se, "fit_softmax", lambda v, c, d, steps, *a: ran.append(steps) or fit(v, c, d, 1, *a))
    assert entry.queries()["linear_probe_full"](spark, SF_SMALL).count() == 2 and ran == [steps]


def test_factorised_equals_naive(spark):
    ex = spark.createDataFrame(
        [(i, f"alpha beta w{i % 3}", f"gamma w{i % 5}", ["entailment", "contradiction", "neutral"][i % 3])
         for i in range(30)], "ex_id long, sentence_a string, sentence_b string, label string")
    var = spark.createDataFrame([(s, f"v{s}{j}", [f"w{j}", "beta", "zzz"]) for s in range(4) for j in range(3)],
                                "seed int, variant_id string, tokens array<string>")
    sc = scoring.AdditiveScorer()
    fitted = sc.fit(ex)
    grid = {(r.variant_id, r.ex_id): list(r.score) for r in sc.score_grid(ex, var).collect()}
    wt = {(sd, r.token): list(r[f"w_{sd}"]) for r in fitted.weights.collect() for sd in range(4) if r[f"w_{sd}"] is not None}
    w0 = fitted.priors
    exs = {r.ex_id: (r.sentence_a + " " + r.sentence_b).split() for r in ex.collect()}
    for v in var.collect():
        for eid, words in exs.items():
            naive = [0, 0, 0]
            for t in words:
                ww = wt.get((v.seed, t), w0[v.seed])
                naive = [a + b for a, b in zip(naive, ww)]
            n = len(v.tokens)
            for i, t in enumerate(v.tokens):
                ww = wt.get((v.seed, t), w0[v.seed])
                naive = [a + (n - i) * b for a, b in zip(naive, ww)]
            assert grid[(v.variant_id, eid)] == naive


def test_results_independent_of_partitioning(spark):
    ex = spark.createDataFrame(
        [(i, f"a{i % 7} b{i % 4}", f"c{i % 5}", ["entailment", "contradiction", "neutral"][i % 3]) for i in range(300)],
        "ex_id long, sentence_a string, sentence_b string, label string")
    var = spark.createDataFrame([(s, f"v{s}", ["a1", "b2"]) for s in range(4)], "seed int, variant_id string, tokens array<string>")
    a = sorted(tuple(r) for r in mt.accuracy(scoring.predict_from_scores(
        scoring.AdditiveScorer().score_grid(ex.coalesce(1), var)), ["variant_id"]).collect())
    b = sorted(tuple(r) for r in mt.accuracy(scoring.predict_from_scores(
        scoring.AdditiveScorer().score_grid(ex.repartition(8), var)), ["variant_id"]).collect())
    assert a == b


# -- F: metrics -----------------------------------------------------------------------
def test_accuracy_empty_is_zero_and_mean_pct_half_up(spark):
    df = spark.createDataFrame([("v", True), ("v", False), ("v", False)], "variant_id string, correct boolean")
    r = mt.accuracy(df, ["variant_id"]).first()
    assert r.acc == round(1 / 3, 6) and r.n_examples == 3
    res = spark.createDataFrame([(0.862499,), (0.8625,)], "acc double")
    assert res.agg(mt.mean_pct("acc")).first()[0] == 86.24995
    res = spark.createDataFrame([(0.000001,)] + [(0.0,)] * 7, "acc double")
    # mean x 100 = 0.0000125 exactly: half-up -> 0.000013
    assert res.agg(mt.mean_pct("acc")).first()[0] == 0.000013


def test_deletion_report_excludes_baseline(spark):
    rows = [("0", 1, 0.5), ("1", 1, 0.25), (None, 0, 1.0), ("0-1-2", 3, 0.1)]
    res = spark.createDataFrame(rows, "del_idx string, n_del int, acc double")
    out = {r.method: r.avg_acc for r in mt.deletion_report(res).collect()}
    assert out["Single token deletion (idx=0)"] == 50.0
    assert out["Multiple token deletion (n=1)"] == 37.5
    assert out["Multiple token deletion (n=3)"] == 10.0
    assert len(out) == 4


def test_strict_best_and_running_mean(spark):
    log = spark.createDataFrame([(1, 0, i + 1, v) for i, v in enumerate([0.5, 0.4, 0.6, 0.6, 0.7])],
                                "run long, epoch long, step long, loss double")
    assert [r.step for r in mt.strict_best(log, ["run"], "step", "loss", start=None).orderBy("step").collect()] == [1, 3, 5]
    assert [r.step for r in mt.strict_best(log, ["run"], "step", "loss", start=0.55).orderBy("step").collect()] == [3, 5]
    # several blocks per run give the same answer as one block
    for b, f in ((1, 1), (1, 2), (2, 1), (2, 2), (3, 1024)):
        got = [r.step for r in mt.strict_best(log, ["run"], "step", "loss", start=None, block=b, fanout=f)
               .orderBy("step").collect()]
        assert got == [1, 3, 5]
    rm = [r.running_loss for r in mt.running_mean(log).orderBy("step").collect()]
    assert rm == [0.5, 0.45, 0.5, 0.525, 0.56]


# -- B: preparation -------------------------------------------------------------------
def _pairs(spark, n):
    return spark.createDataFrame([(i, f"a {i}", f"b {i}", ["entailment", "neutral"][i % 2]) for i in range(n)],
                                 "ex_id long, sentence_a string, sentence_b string, label string")


def test_nested_subsets_are_prefixes_and_holdout_disjoint(spark):
    df = _pairs(spark, 150)
    sub = prepare.nested_subsets(df, [0, 1]).collect()
    for seed in (0, 1):
        sets = {n: {r.ex_id for r in sub if r.seed == seed and r.size == n} for n in prepare.NESTED_SIZES}
        for a, b in zip(prepare.NESTED_SIZES, prepare.NESTED_SIZES[1:]):
            assert sets[a] < sets[b] and len(sets[a]) == a
    train, dev = prepare.holdout(df, 50, 0)
    t, d = {r.ex_id for r in train.collect()}, {r.ex_id for r in dev.collect()}
    assert len(d) == 50 and not (t & d) and len(t | d) == 150


def test_sample_larger_than_population_fails(spark):
    import pytest
    with pytest.raises(ValueError):
        prepare.sample_exact(_pairs(spark, 5), 6, 0)
    assert prepare.sample_exact(_pairs(spark, 5), 0, 0).count() == 5


def test_unknown_label_fails(spark):
    import pytest
    df = spark.createDataFrame([(1, "maybe")], "ex_id long, label string")
    with pytest.raises(Exception):
        prepare.encode_fixed(df).collect()


def test_swap_objects_always_changes_label(spark):
    # three evidences per fact, one of them longer than the cap: one row per fact comes out
    rows = [(f"s{i}", f"o{i % 4}", 10 * i + j, f"surf{i % 4}", "[MASK] x" + " w" * (60 if j == 2 else 0))
            for i in range(40) for j in range(3)]
    f = spark.createDataFrame(rows, "sub_label string, obj_label string, ev_id long, obj_surface string, masked_sentence string")
    out = prepare.swap_objects(f, 0).collect()
    orig = {r[0]: r[1] for r in rows}
    assert len(out) == 40 == len({r.sub_label for r in out})
    for r in out:
        assert r.obj_label != orig[r.sub_label]
        assert r.context.startswith(f"surf{r.obj_label[1:]} x") and len(r.context.split()) in (2, 50)


def test_truncate_head_keeps_tail(spark):
    df = spark.createDataFrame([(list(range(300)),), (list(range(5)),)], "ids array<int>")
    out = [r.ids for r in prepare.truncate_head(df, "ids").collect()]
    assert out[0] == list(range(44, 300)) and out[1] == list(range(5))


# -- skew-safe ranking ----------------------------------------------------------------
def test_row_number_within_matches_window_on_skew(spark):
    rows = [(0 if i % 3 else i % 7, i) for i in range(3000)]  # key 0 holds two thirds
    df = spark.createDataFrame(rows, "g long, o long").repartition(7)
    a = {(r.g, r.o): r.rn for r in row_number_within(df, ["g"], ["o"]).collect()}
    w = Window.partitionBy("g").orderBy("o")
    b = {(r.g, r.o): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert a == b
    pos = sorted(r._p for r in global_position(df, ["g", "o"], "_p").collect())
    assert pos == list(range(3000))


def test_next_row_matches_lead(spark):
    df = spark.createDataFrame([(i * 3 % 101, f"t{i}") for i in range(101)], "k long, v string").repartition(5)
    a = {r.k: r.next_v for r in next_row(df, ["k"], ["v"]).collect()}
    b = {r.k: r.nv for r in df.withColumn("nv", F.lead("v").over(Window.orderBy("k"))).collect()}
    assert a == b


# -- C5 parity and the E8 model hook -------------------------------------------------------
def test_scatter_fills_in_order_and_parity_mode(spark):
    from robustq.plans.q_prompts import scatter, scatter_parity
    df = spark.createDataFrame([(1, ["a", "[T]", "[T]", "b"], ["x", "y", "z"]),
                                (2, ["[T]", "[T]", "[T]"], ["x", "y"])],
                               "ex_id long, tokens array<string>, trig array<string>")
    got = {r.ex_id: r.tokens for r in scatter(df).collect()}
    assert got[1] == ["a", "x", "y", "b"]            # surplus trigger tokens ignored
    assert got[2] == ["[T]", "[T]", "[T]"]           # too few tokens: unchanged
    one = spark.createDataFrame([(i, ["s", "[T]", "e"], [f"t{j}" for j in range(10)]) for i in range(40)],
                                "ex_id long, tokens array<string>, trig array<string>")
    p = {r.ex_id: r.tokens[1] for r in scatter_parity(one, ["ex_id"]).collect()}
    assert p[0] == "t0" and p[9] == "t9" and p[10] == "t0" and p[31] == "t1" and p[32] == "t0"


def test_model_hook_scores_in_arrow_batches(spark):
    import pandas as pd
    ex = spark.createDataFrame([(i, "a b", "c", "entailment") for i in range(20)],
                               "ex_id long, sentence_a string, sentence_b string, label string")
    var = spark.createDataFrame([(s, f"v{s}", ["x"]) for s in range(2)], "seed int, variant_id string, tokens array<string>")

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.variant_id, r.ex_id, lab, float(len(r.sentence_a) + k))
                for r in pdf.itertuples() for k, lab in enumerate(["entailment", "contradiction", "neutral"])]
        return pd.DataFrame(rows, columns=["variant_id", "ex_id", "label", "logit"])

    schema = "variant_id string, ex_id long, label string, logit double"
    out = scoring.score_with_model(ex, var, model, schema)
    assert out.count() == 20 * 2 * 3
    # past the broadcast limit the pairs come from the bucketed join: same rows
    bucketed = scoring.score_with_model(ex, var, model, schema, max_rows=1)
    assert sorted(map(tuple, bucketed.collect())) == sorted(map(tuple, out.collect()))


def test_pair_perturbed_with_missing_rows(spark):
    # The label-change set lacks a row of the original set; pairing is by key
    orig = spark.createDataFrame([(1, "entailment"), (2, "contradiction"), (3, "neutral")], "ex_id long, label string")
    pert = spark.createDataFrame([(1, "contradiction"), (3, "entailment")], "ex_id long, label string")
    out = {(r.label_from, r.label_to): r.n for r in perturb.pair_perturbed(orig, pert, ["ex_id"]).collect()}
    assert out == {("entailment", "contradiction"): 1, ("neutral", "entailment"): 1}


def test_gold_lookup_fails_on_unknown_and_confusion(spark):
    import pytest
    ok = _vec(spark, [(0, [0.0] * 64, 3), (1, [0.0] * 64, 9)])
    assert {r.vec_id: r.label_name for r in scoring.gold_label_lookup(ok).collect()} == {0: 3, 1: 9}
    bad = _vec(spark, [(0, [0.0] * 64, 42)])
    with pytest.raises(Exception):
        scoring.gold_label_lookup(bad).collect()


def test_read_any_dispatch(spark, tmp_path):
    import pytest

    from robustq.sources import io
    d = tmp_path / "pairs.tsv"
    rows = [("1", 'he said "hi"', "b", "neutral"), ("2", "  lead", "trail  ", None), ("3", "", "a\\b", "x")]
    io.write_pairs(spark.createDataFrame(rows, io.PAIRS_SCHEMA).coalesce(1), str(d))
    assert sorted(tuple(r) for r in io.read_any(spark, str(d)).collect()) == rows
    m = tmp_path / "multi.tsv"
    rows = [("1", "two\nlines", "b", "x")]
    io.write_pairs(spark.createDataFrame(rows, io.PAIRS_SCHEMA), str(m))
    assert [tuple(r) for r in io.read_pairs(spark, str(m), multi_line=True).collect()] == rows
    with pytest.raises(ValueError):
        io.read_any(spark, str(tmp_path / "x.csv"))


def test_encode_tokens_keeps_wordless_rows(spark):
    df = spark.createDataFrame([(1, "a b zz"), (2, "   "), (3, "b")], "ex_id long, t string")
    voc = spark.createDataFrame([("a", 5), ("b", 6)], "token string, token_id long")
    got = {r.ex_id: r.ids for r in prepare.encode_tokens(df, "t", voc).collect()}
    assert got == {1: [5, 6, 3], 2: [], 3: [6]}


def test_eval_marks_are_per_pass(spark):
    log = spark.createDataFrame([(1, i, float(i)) for i in range(1, 101)], "run long, step long, loss double")
    got = {r.step: r.avg_loss for r in mt.eval_marks(log, 5, 200, 16).collect()}
    assert got == {m: ((m - 1) // 13 * 13 + 1 + m) / 2 for m in range(5, 101, 5)}


def test_multilevel_windows_match_plain_windows(spark):
    import random
    rnd = random.Random(7)
    rows = [(r, s, float(rnd.randint(0, 50))) for r in (1, 2) for s in range(1, 60)]
    log = spark.createDataFrame(rows, "run long, step long, loss double")
    w = Window.partitionBy("run").orderBy("step")
    prev = F.max("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = {(r.run, r.step) for r in log.withColumn("p", prev).filter(F.col("loss") > F.coalesce("p", F.lit(float("-inf")))).collect()}
    got = {(r.run, r.step) for r in mt.strict_best(log, ["run"], "step", "loss", start=None, block=3, fanout=2).collect()}
    assert got == want


def test_stream_accuracy_accumulates_and_resumes(spark):
    """H1: per-variant counts accumulate over micro-batches (one file each); a restart from
    the checkpoint reads only the new file and keeps the state of the earlier ones."""
    from robustq.sources.io import scratch_dir
    from robustq.streaming.accuracy import run_available
    base = scratch_dir(spark, "stream-test")
    parts = [[("a", True), ("a", False), ("b", True)], [("a", True), ("b", False)], [("b", True), ("c", False)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "variant_id string, correct boolean").coalesce(1) \
            .write.parquet(f"{base}/in/p{i}")
    src = f"{base}/in/*"
    got = {r.variant_id: (r.n_correct, r.n_examples) for r in
           run_available(spark, src, f"{base}/out", f"{base}/ckpt", ["variant_id"]).collect()}
    assert got == {"a": (2, 3), "b": (2, 3), "c": (0, 1)}
    assert n_commits(spark, f"{base}/ckpt") == 3  # one micro-batch per file
    spark.createDataFrame([("c", True), ("c", True)], "variant_id string, correct boolean").coalesce(1) \
        .write.parquet(f"{base}/in/p3")
    got = {r.variant_id: (r.n_correct, r.n_examples) for r in
           run_available(spark, src, f"{base}/out", f"{base}/ckpt", ["variant_id"]).collect()}
    assert got == {"a": (2, 3), "b": (2, 3), "c": (2, 3)}
    assert n_commits(spark, f"{base}/ckpt") == 4


def n_commits(spark, ckpt):
    """Committed micro-batches of a streaming checkpoint (one commit file per batch id)."""
    files = spark.read.text(f"{ckpt}/commits/[0-9]*").select(F.input_file_name().alias("f")).distinct()
    return files.count()


def test_greedy_search_log_invariants(spark):
    """G7 log: accepted flips strictly improve the training count; the current trigger's
    count is the last accepted count; after the first, bests strictly increase; one
    initial dev row per seed."""
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL
    rows = sorted(entry.queries()["greedy_trigger_search"](spark, SF_SMALL).collect(),
                  key=lambda r: (r.seed, r.iter))
    seeds = {r.seed for r in rows}
    assert sorted(r.seed for r in rows if r.iter == -1) == sorted(seeds)
    for s in seeds:
        last_new, best = None, None
        for r in [r for r in rows if r.seed == s and r.iter >= 0]:
            if r.token is None:
                assert r.dev_acc is None and not r.new_best
                continue
            assert r.new_correct > r.cur_correct
            if last_new is not None:
                assert r.cur_correct == last_new
            last_new = r.new_correct
            if r.new_best:
                assert best is None or r.dev_acc > best
                best = r.dev_acc
            else:
                assert best is not None and r.dev_acc <= best


def test_step_windows_on_a_gapped_order_column(spark):
    """F7/F8 with dense=False: any unique order column (gaps allowed) gives the answer of
    plain windows over row positions."""
    import random
    rnd = random.Random(11)
    rows, t = [], 0
    for r in (1, 2):
        for _ in range(40):
            t += rnd.randint(1, 9)
            rows.append((r, t, float(rnd.randint(0, 30))))
    log = spark.createDataFrame(rows, "run long, ts long, loss double")
    w = Window.partitionBy("run").orderBy("ts")
    prev = F.max("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = {(r.run, r.ts) for r in log.withColumn("p", prev)
            .filter(F.col("loss") > F.coalesce("p", F.lit(float("-inf")))).collect()}
    got = {(r.run, r.ts) for r in mt.strict_best(log, ["run"], "ts", "loss", start=None, block=3,
                                                 fanout=2, dense=False).collect()}
    assert got == want
    n = F.row_number().over(w)
    cum = {(r.run, r.n): round(r.c, 6) for r in
           log.withColumn("n", n).withColumn("g", F.floor((F.col("n") - 1) / 13))
              .withColumn("c", F.avg("loss").over(Window.partitionBy("run", "g").orderBy("n")
                                                  .rowsBetween(Window.unboundedPreceding, 0)))
              .filter(F.col("n") % 4 == 0).collect()}
    marks = {(r.run, r.ts): r.avg_loss for r in mt.eval_marks(log, 4, 200, 16, order="ts", dense=False).collect()}
    assert marks == cum


def test_grid_without_broadcast_matches(spark):
    """Past the broadcast limit the grid joins hash buckets of variants with replicated
    example rows, and the weights are a shuffle join: same predictions as the broadcast
    plan."""
    from robustq.plans import experiments as ex
    from robustq.plans import fixtures as fx
    from tests.conftest import SF_SMALL
    v1, trig = fx.grid_inputs(spark, SF_SMALL)
    var = ex.ap_deletion_variants(trig)

    def preds(scorer):
        return {tuple(r) for r in ex.predictions(v1, var, scorer=scorer, materialized=True)
                .select("variant_id", "ex_id", "pred", "correct").collect()}

    small = scoring.AdditiveScorer(broadcast_max_rows=10)
    base = preds(scoring.AdditiveScorer())
    assert len(base) == 164 * v1.count()
    assert preds(small) == base


def test_materialize_all_keeps_order_and_raises(spark):
    import pytest

    from robustq.functions.materialize import materialize_all
    a = spark.range(0, 100, 1, 3).withColumn("k", F.col("id") * 2)
    b = spark.createDataFrame([("x", 1), ("y", 2)], "s string, n int")
    ma, mb = materialize_all(a, b)
    assert sorted(r.k for r in ma.collect()) == [2 * i for i in range(100)]
    assert sorted(map(tuple, mb.collect())) == [("x", 1), ("y", 2)]
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))
    with pytest.raises(Exception, match="boom"):
        materialize_all(a, bad)
