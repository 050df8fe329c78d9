"""Committed folders, unreadable rows, late and repeated predictions, distinct orders, near pairs."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from robustq.functions.bind import bind, bind2
from robustq.functions import text as tx
from robustq.operators import nearpair as npair
from robustq.operators import perturb
from robustq.operators import prepare as pr
from robustq.sources import committed as cm
from robustq.sources import io


# -- committed folders ------------------------------------------------------------------
def _results(spark, acc):
    row = ("e", "t", "m", 1, "tmpl", acc, None, 0, 9)
    return spark.createDataFrame([row], io.SUMMARY_SCHEMA)


def test_rerun_takes_its_own_place(spark, tmp_path):
    base = str(tmp_path / "s")
    for acc in (0.1, 0.2, 0.3):
        io.write_summary(_results(spark, acc), base, run="a/1")
        assert [r["acc"] for r in io.read_summary(spark, base).collect()] == [acc]
    io.write_summary(_results(spark, 0.9), base, run="b")
    assert sorted(r["acc"] for r in io.read_summary(spark, base).collect()) == [0.3, 0.9]
    assert list(cm.committed(spark, base)) == ["a/1", "b"]
    # the last two versions of a run are kept
    kept = [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("a%2F1-")]
    assert len(kept) == 2


def test_a_killed_write_is_never_read(spark, tmp_path):
    base = str(tmp_path / "s")
    io.write_summary(_results(spark, 0.5), base)
    dies = F.when(F.col("seed") == 1, F.raise_error(F.lit("killed")).cast("double")).otherwise(0.0)
    half = _results(spark, 0.7).union(_results(spark, 0.8).withColumn("seed", F.lit(2))).withColumn("acc", dies)
    with pytest.raises(Exception, match="killed"):
        io.write_summary(half, base)

    def stops(folder):
        _results(spark, 0.6).write.parquet(folder)
        raise KeyboardInterrupt
    with pytest.raises(KeyboardInterrupt):
        cm.write_committed(spark, base, "results", stops)
    assert [r["acc"] for r in io.read_summary(spark, base).collect()] == [0.5]
    io.write_summary(_results(spark, 0.4), base)
    assert [r["acc"] for r in io.read_summary(spark, base).collect()] == [0.4]
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("results-")]) == 2


def test_published_runs_can_be_left_alone(spark, tmp_path):
    base, calls = str(tmp_path / "s"), []
    for _ in range(2):
        cm.write_committed(spark, base, "r", lambda f: calls.append(f) or _results(spark, 1.0).write.parquet(f),
                           replace=False)
    assert len(calls) == 1
    with pytest.raises(FileNotFoundError):
        io.read_summary(spark, str(tmp_path / "none"))


def test_label_tokens_are_published_together(spark, tmp_path):
    lm = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "label string, pos int, token string")
    for _ in range(2):
        io.write_label_tokens(lm, str(tmp_path))
    per, js = io.read_label_tokens(spark, str(tmp_path))
    assert per.count() == 3 and js.count() == 1


# -- unreadable rows --------------------------------------------------------------------
def test_unreadable_lines_are_kept_with_their_reason(spark, tmp_path):
    (tmp_path / "p").mkdir()
    lines = ["\tex_id\tsentence_a\tsentence_b\tlabel", '0\t1\t"a ""q"" b"\tc\tneutral', "1\t2\tonly\tthree",
             "2\t3\ta\tb\tneutral\tmore", '3\t4\ta\t"open\tneutral', "4\t5\ta\tb\t\\N", "5\t6\ta\tb\tentailment"]
    (tmp_path / "p" / "x.tsv").write_text("\n".join(lines) + "\n")
    ok, bad = pr.split_valid(io.read_pairs_checked(spark, str(tmp_path / "p")), io.unreadable_pairs())
    assert sorted((r["ex_id"], r["sentence_a"], r["label"]) for r in ok.collect()) == [
        ("1", 'a "q" b', "neutral"), ("6", "a", "entailment")]
    assert sorted((r["reason"], r[io.CORRUPT]) for r in bad.collect() if r[io.CORRUPT]) == [
        ("field_count", lines[2]), ("field_count", lines[3]), ("open_quote", lines[4])]
    assert [r["ex_id"] for r in bad.where("reason = 'no_label'").collect()] == ["5"]

    (tmp_path / "f").mkdir()
    facts = ['{"sub_label":"s","obj_label":"o","evidences":[{"obj_surface":"x","masked_sentence":"m"}]}',
             '{"sub_label":"s","obj_label":"o","evi', '{"sub_label":"s","obj_label":"o"}',
             '{"sub_label":"s","obj_label":"o","evidences":[]}', "{broken}"]
    (tmp_path / "f" / "x.jsonl").write_text("\n".join(facts) + "\n")
    ok, bad = pr.split_valid(io.read_facts_checked(spark, str(tmp_path / "f")), io.unreadable_facts())
    assert ok.count() == 1
    assert Counter(r["reason"] for r in bad.collect()) == {"cut_short": 1, "not_a_record": 1, "no_evidences": 2}


# -- streams ----------------------------------------------------------------------------
def test_repeated_and_late_files_change_nothing(spark, tmp_path):
    from robustq.streaming.accuracy import TIMED_SCHEMA, run_available
    import datetime as dt
    t = dt.datetime(2024, 1, 2, 12)

    def land(rows):
        spark.createDataFrame(rows, TIMED_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        out = run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"),
                            ["variant_id"], TIMED_SCHEMA, delay="10 minutes")
        return {r["variant_id"]: (r["n_correct"], r["n_examples"]) for r in out.collect()}
    first = [("v", "1", True, t), ("v", "2", False, t), ("w", "1", True, t)]
    land(first)
    assert run() == {"v": (1, 2), "w": (1, 1)}
    land(first)                                          # delivered again
    assert run() == {"v": (1, 2), "w": (1, 1)}
    land([("v", "3", True, t + dt.timedelta(hours=2))])  # moves the watermark
    assert run() == {"v": (2, 3), "w": (1, 1)}
    land([("v", "9", True, t)])                          # too late
    land([("w", "2", False, t + dt.timedelta(hours=2))])
    assert run() == {"v": (2, 3), "w": (1, 2)}


# -- distinct orders --------------------------------------------------------------------
@pytest.mark.parametrize("n,reps", [(1, 4), (2, 10), (3, 6), (3, 4), (10, 40), (25, 40)])
def test_orders_are_distinct(spark, n, reps):
    df = spark.createDataFrame([(s, [f"t{i}" for i in range(n)]) for s in range(30)], "seed int, tokens array<string>")
    got = perturb.reorder_distinct(df, reps=reps).collect()
    by = {}
    for r in got:
        by.setdefault(r["seed"], []).append(tuple(r["tokens"]))
    want = min(reps, len(list(itertools.permutations(range(n))))) if n < 6 else reps
    for orders in by.values():
        assert len(orders) == len(set(orders)) == want
        assert all(sorted(o) == sorted(f"t{i}" for i in range(n)) for o in orders)
    assert len(by) == 30 and (n < 3 or len({o[0] for o in by.values()}) > 2)


def test_orders_are_even(spark):
    df = spark.range(3000).select(F.col("id").alias("seed"), F.array(*[F.lit(x) for x in "abc"]).alias("tokens"))
    c = Counter("".join(r["tokens"]) for r in perturb.reorder_distinct(df, reps=1).collect())
    assert len(c) == 6 and all(400 < n < 600 for n in c.values())
    wide = spark.range(2000).select(F.col("id").alias("seed"), F.array(*[F.lit(x) for x in "abcdefghij"]).alias("tokens"))
    rows = perturb.reorder_distinct(wide, reps=2).collect()
    for at in (0, 5, 9):
        c = Counter(r["tokens"][at] for r in rows)
        assert len(c) == 10 and all(300 < n < 500 for n in c.values())


def test_empty_rows_have_no_orders(spark):
    df = spark.createDataFrame([(1, []), (2, None)], "seed int, tokens array<string>")
    assert perturb.reorder_distinct(df).count() == perturb.reorder_all(df).count() == 0
    assert perturb.delete_subsets(df).count() == 0


def test_large_rows_are_refused_not_wrapped(spark):
    long = spark.createDataFrame([(1, [str(i) for i in range(63)])], "seed int, tokens array<string>")
    with pytest.raises(Exception, match="more than 62 tokens"):
        perturb.delete_subsets(long).count()
    with pytest.raises(Exception, match="more than 20 tokens"):
        perturb.reorder_all(long).count()
    # 31 tokens overflowed 32 bits before: numbers are counted in 64
    some = spark.createDataFrame([(1, [str(i) for i in range(33)])], "seed int, tokens array<string>")
    assert perturb._numbered(some, F.lit(1 << 33) - 1, "m").limit(5).count() == 5


# -- evaluation once a row --------------------------------------------------------------
def test_bound_values_are_evaluated_once(spark):
    acc = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def seen(n):
        acc.add(1)
        return list(range(n))
    df = spark.range(1, 11).select(bind(seen(F.col("id").cast("int")), lambda a: F.transform(
        a, lambda x: x + F.size(a))).alias("x"))
    assert df.agg(F.sum(F.size("x"))).first()[0] == 55 and acc.value == 10
    two = spark.range(3).select(bind2(F.lit(2), F.col("id"), lambda a, b: a * b).alias("x")).collect()
    assert [r["x"] for r in two] == [0, 2, 4]


def test_one_very_long_text(spark):
    """100,000 words: chunks and everything built on them are linear in the text."""
    import time
    text = " ".join(f"w{i % 977}" for i in range(100_000))
    df = spark.createDataFrame([("d", text)], "ex_id string, text string")
    start = time.monotonic()
    c = perturb.chunk_tokens(df, "text", 10)
    assert c.count() == 10_000 and c.agg(F.sum(F.size("tokens"))).first()[0] == 100_000
    assert perturb.delete_each(c.select("ex_id", "chunk", "tokens")).count() == 100_000
    assert time.monotonic() - start < 30


def test_repeated_ids_stay_rows_of_their_own(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "y x x"), ("a", "x y"), ("b", ""), ("c", None)],
                               "ex_id string, text string")
    voc = spark.createDataFrame([("x", 5, 900_000), ("y", 6, 2)], "token string, token_id bigint, freq bigint")
    got = sorted((r["ex_id"], r["ids"]) for r in pr.encode_tokens(df, "text", voc).collect())
    assert got == [("a", [5, 6]), ("a", [5, 6]), ("a", [6, 5, 5]), ("b", []), ("c", [])]
    plain = sorted((r["ex_id"], r["ids"]) for r in pr.encode_tokens(df, "text", voc.drop("freq")).collect())
    assert plain == got


def test_only_words_outside_the_dictionary_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(pr, "DICTIONARY_WORDS", 2)
    df = spark.createDataFrame([(1, "a", "x  y\tz z\nz\rq"), (2, "a", "x x"), (3, None, None), (4, "b", " w x z ")],
                               "_row bigint, ex_id string, text string")
    voc = spark.createDataFrame([("x", 5, 9), ("y", 6, 7), ("z", 7, 2), ("w", 8, 2)],
                                "token string, token_id bigint, freq bigint")
    assert pr._dictionary(voc) == {"x": 5, "y": 6}
    hot = spark.sparkContext.broadcast(pr._dictionary(voc))
    rare = pr._rare_words(df.withColumn("_text", df["text"]), hot).collect()
    assert sorted(map(tuple, rare)) == [(1, "q"), (1, "z"), (4, "w"), (4, "z")]
    got = pr.encode_tokens(df, "text", voc)
    assert sorted(map(tuple, got.collect())) == [(1, "a", [5, 6, 7, 7, 7, 3]), (2, "a", [5, 5]), (3, None, []),
                                                 (4, "b", [8, 5, 7])]
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_normalized_texts_are_their_words(spark):
    texts = ["", " ", "a", " a ", "\t\na  b\r\n c \x0b d\n", "a b c", "\n", None, "a \t", "\u00a0 x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(tx.normalize("t").alias("n"), F.array_join(tx.words("t"), " ").alias("w")).collect()
    assert all(r["n"] == r["w"] for r in rows)


# -- near pairs -------------------------------------------------------------------------
def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _brute(orig, pert, q, share):
    out = []
    for t in pert:
        k = max(0, min(int(len(t) * share), (len(t) - q) // q)) if t is not None else -1
        best = min(((_distance(a, t), key) for key, a in orig if a is not None and abs(len(a) - len(t)) <= k), default=None) \
            if t is not None else None
        out.append((t, *(best[::-1] if best and best[0] <= k else (None, None))))
    return sorted(out, key=repr)


def _near(spark, orig, pert, **kw):
    a = spark.createDataFrame(orig, "key int, text string").repartition(3)
    b = spark.createDataFrame([(t,) for t in pert], "text string").repartition(2)
    return sorted(((r["text"], r["orig_key"], r["distance"]) for r in npair.pair_near(a, b, "text", "key", **kw)
                   .collect()), key=repr)


@pytest.mark.parametrize("q,share", [(3, 0.1), (3, 0.2), (2, 0.3)])
def test_near_pairs_equal_all_pairs(spark, q, share):
    rng = random.Random(q)
    def word():
        return "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    orig = [(i, " ".join(word() for _ in range(rng.randrange(0, 14)))) for i in range(120)]
    orig += [(500, orig[3][1]), (501, None), (502, "")]
    pert = []
    for _, t in orig[:100]:
        x = list(t or "")
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(x) + 1)
            x[at:at + rng.randrange(2)] = rng.choice("abcé ")
        pert.append("".join(x))
    pert += [orig[0][1], None, "", "zzzzzzzzzzzzzzzzzzzzzz"]
    assert _near(spark, orig, pert, q=q, share=share) == _brute(orig, pert, q, share)


def test_all_fifty_rows_pair(spark):
    """Fifty originals, each reworded a little; one differs by a quote and a space only."""
    rng = random.Random(50)
    words = ["reports", "said", "the", "plane", "was", "never", "seen", "over", "that", "river", "again", "because"]
    orig = [(i, " ".join(rng.choice(words) for _ in range(25)) + f" {i * i}") for i in range(50)]
    pert = [t.replace("the", "a", 1) if i % 2 else "not " + t for i, t in orig]
    pert[7] = "\"" + orig[7][1] + "\" "
    got = {t: k for t, k, _ in _near(spark, orig, pert)}
    assert [got[t] for t in pert] == list(range(50))


def test_near_pairs_of_empty_sides(spark):
    assert _near(spark, [(1, "some words here")], []) == []
    assert _near(spark, [], ["some words here"]) == [("some words here", None, None)]


# -- line breaks in quoted fields -------------------------------------------------------
@pytest.mark.parametrize("line,inside,want", [
    ("a\tb", False, False), ('a\t"b', False, True), ('a\t"b"', False, False), ('a\t5" disk', False, False),
    ('b"\tc', True, False), ('b""', True, True), ('b"""', True, False), ('x"\t"y', True, True), ("", True, True),
    ("", False, False), ('"a"" b"\t"c', False, True), ('"a"rest "\tb', False, False)])
def test_open_quotes(line, inside, want):
    from robustq.sources.quoted import ends_inside
    assert ends_inside(line, inside) is want


def test_quoted_line_breaks_in_many_tasks_per_file(spark, tmp_path):
    import csv

    from robustq.sources.quoted import _lines, read_quoted_pairs
    rng = random.Random(4)
    bits = ["word", "\n", "\n\n", '"', '""', "a\tb", " ", "é漢", "x" * 40, '"\n"', "'"]
    rows = [(str(i), "".join(rng.choice(bits) for _ in range(rng.randrange(60))),
             "".join(rng.choice(bits) for _ in range(rng.randrange(5))) or "b", "neutral") for i in range(400)]
    rows[7] = ("7", "\n".join(["one field over many splits"] * 900), "b", "neutral")
    (tmp_path / "in").mkdir()
    for n, part in (("a.tsv", rows[:250]), ("b.tsv", rows[250:])):
        with open(tmp_path / "in" / n, "w", newline="") as f:
            w = csv.writer(f, delimiter="\t", lineterminator="\n")
            w.writerow(["", "ex_id", "sentence_a", "sentence_b", "label"])
            w.writerows([(i, *r) for i, r in enumerate(part)])
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        path = str(tmp_path / "in")
        assert _lines(spark, path).select("file", "block").distinct().count() > 20
        got = [tuple(r) for r in read_quoted_pairs(spark, path).collect()]
    finally:
        spark.conf.set(key, old)
    # an empty field that is not quoted reads as null
    assert sorted((a, b or "", c, d) for a, b, c, d in got) == sorted(rows)
