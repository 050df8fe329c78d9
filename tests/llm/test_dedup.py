"""SimHash near-dedup, repeated spans, line dedup and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from robustq.llm import decontaminate as dc
from robustq.llm import graph
from robustq.llm import line_dedup as ld
from robustq.llm import simhash_dedup as sd
from robustq.llm import suffix_dedup as sx
from tests.llm import brute


# -- SimHash ------------------------------------------------------------------------
def test_simhash_matches_brute_force(small, small_rows):
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"])
           for r in sd.near_duplicates(small).collect()}
    fps = [(d, brute.fingerprint(t)) for d, t in small_rows]
    comp = brute.components(fps)
    assert got == {d: (f, comp[d]) for d, f in fps}


def test_components_agree_beyond_the_broadcast_limit(spark, small, monkeypatch):
    docs = small.select("doc_id", "text").limit(60).unionByName(
        spark.range(40).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit("one text of many copies").alias("text")))
    want = sorted(map(tuple, sd.near_duplicates(docs).collect()))
    from robustq.llm import common
    monkeypatch.setattr(common, "broadcast_if_bounded", lambda d, *a: d)
    assert sorted(map(tuple, sd.near_duplicates(docs).collect())) == want


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("bits,segments,bucket", [(2, 2, 64), (2, 2, 1), (3, 2, 64), (3, 2, 1),
                                                  (1, 3, 2), (4, 3, 1)])
def test_links_close_like_all_pairs(spark, bits, segments, bucket):
    rng = random.Random(bits * 7 + bucket)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(12):
            x = c
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(_signed(x),) for x in fps], "fp bigint")
    links = sd.fingerprint_links(df, bits, segments, bucket)
    got = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
    want = brute.components([(_signed(x), x) for x in fps], bits)
    assert {n: got.get(n, n) for n in want} == want


def test_dense_bucket_needs_no_pairs(spark):
    # every fingerprint within two bits of one centre: hot buckets, one component
    fps = [0] + [1 << i for i in range(63)] + [(1 << i) | (1 << j) for i in range(40)
                                               for j in range(i)]
    links = sd.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp bigint"))
    n = links.count()
    assert n < 67 * len(fps)
    comp = {r["component"] for r in graph.connected_components(links).collect()}
    assert comp == {0}


def test_simhash_edge_cases(edge):
    rows = sd.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert by[3]["fp"] == by[4]["fp"] == by[5]["fp"] == 0 and by[5]["component_id"] == 3
    kept = [r["doc_id"] for r in sd.keep_first(edge).collect()]
    assert 2 not in kept and {1, 3, None} <= set(kept) and 4 not in kept
    assert sd.near_duplicates(edge.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    e = spark.range(1, 300).selectExpr("id as a", "id - 1 as b")
    got = graph.connected_components(e).collect()
    assert len(got) == 300 and {r["component"] for r in got} == {0}


# -- repeated spans -----------------------------------------------------------------
def _texts(seed):
    rng = random.Random(seed)
    def word():
        return "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(3, 20))) for _ in range(6)]
    out = [" ".join(rng.choice(passages) if rng.random() < 0.3 else word()
                    for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    return out + ["ab" * 60, "ab" * 35, "a" * 90, "", None, out[3], "é" * 30 + passages[0]]


@pytest.mark.parametrize("length,anchor,rounds", [(20, 15, 1), (20, 10, 2), (21, 8, 3),
                                                  (24, 24, 1), (20, 15, 4)])
def test_spans_match_brute_force(spark, length, anchor, rounds):
    texts = _texts(length + rounds)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in sx.remove_repeats(df, length=length, anchor=anchor,
                                                     rounds=rounds).collect()}
    want = brute.spans([(t or "").encode() for t in texts], length)
    for i, (removed, runs, kept) in enumerate(want):
        r = got[i]
        assert (r["n_removed"], len(r["spans"]) // 2, bytes(r["kept"])) == (removed, runs, kept)
        assert r["kept_sha256"] == brute.sha(kept) and r["n_bytes"] == removed + len(kept)


def test_long_texts_come_in_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(sx, "PIECE", 50)
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(500))
    col = pa.array([text, "short", None, text[:49]])
    seen = Counter()
    for data, rows, st, en, at in sx._pieces(col, 20):
        t, lo, n, _, _ = sx._runs(data, st, en, 20, 15)
        for a, b, c in zip(t.tolist(), lo.tolist(), n.tolist()):
            for p in range(b, b + c):
                seen[(int(rows[a]), int(p - st[a] + at[a]))] += 1
    assert set(seen.values()) == {1}
    assert sorted(p for r, p in seen if r == 0) == list(range(481))
    assert sorted(p for r, p in seen if r == 3) == list(range(30))


def test_span_edge_cases(edge):
    rows = sx.remove_repeats(edge, length=30).collect()
    assert len(rows) == edge.count()
    twice = [r for r in rows if r["doc_id"] in (1, 2)]
    assert len(twice) == 3 and all(r["n_removed"] == r["n_bytes"] for r in twice)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_bytes"] == 0 and by[8]["n_removed"] >= 149_000
    assert sx.remove_repeats(edge.limit(0)).count() == 0


def test_schedule_reaches_the_length():
    for length in (2, 7, 400, 401):
        for rounds in (1, 2, 3):
            start, offsets = sx.schedule(length, rounds)
            assert start + sum(offsets) == length or length == 1
            have = start
            for o in offsets:
                assert o <= have
                have += o


# -- line dedup ---------------------------------------------------------------------
def _lines(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = ld.drop_repeated_lines(df, **kw).collect()
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in rows)


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("batches", [1, 3, 6])
def test_lines_match_brute_force(spark, monkeypatch, broadcast, batches):
    if not broadcast:  # the salted way for frequent keys that are too many to broadcast
        monkeypatch.setattr(ld, "broadcast_if_bounded", lambda df, width: df)
    rng = random.Random(batches)
    pool = [f"  {c * 12} Line number {c} of the pool with words " for c in "abcdefgh"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < .6 else f"own {i} {j}"
                          for j in range(rng.randrange(1, 9)))) for i in range(60)]
    docs += [(7, docs[7][1]), (None, pool[0]), (61, None), (62, ""), (63, pool[1].upper())]
    want = Counter((d, *b) for (d, _), b in zip(docs, brute.line_dedup(docs)))
    assert _lines(spark, docs, batches=batches) == want


def test_levels_are_compacted(spark):
    runs = ld.LineRuns(spark, buckets=2, fanout=2)
    for i in range(5):
        batch = spark.createDataFrame([(k, k, 1, 10 - i) for k in range(i, i + 3)],
                                      "h1 bigint, h2 bigint, n_docs bigint, owner bigint")
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {r["h1"]: (r["n_docs"], r["owner"]) for r in runs.merged().collect()}
    runs.close()
    assert got == {0: (1, 10), 1: (2, 10), 2: (3, 10), 3: (3, 9), 4: (3, 8), 5: (2, 7), 6: (1, 6)}


def test_line_edge_cases(edge):
    out = ld.drop_repeated_lines(edge, min_docs=1).collect()
    assert len(out) == edge.count()
    by = {r["doc_id"]: r for r in out}
    assert by[3]["text"] is None and by[3]["n_lines"] == 1 and by[10]["n_dropped"] == 0
    assert by[1]["n_dropped"] == 1 and by[2]["n_dropped"] == 0 and by[1]["text"] == ""
    assert ld.drop_repeated_lines(edge.limit(0)).count() == 0


# -- decontamination ----------------------------------------------------------------
@pytest.mark.parametrize("window", [4, 10])
def test_contamination_matches_brute_force(spark, window):
    rng = random.Random(window)
    def words(n):
        return " ".join(rng.choice("abcdefghijkl") for _ in range(n))
    items = [(i, words(rng.randrange(0, 18))) for i in range(30)]
    items += [(30, items[3][1]), (31, None), (None, words(12)), (32, ""), (33, "a  B-c")]
    texts = []
    for i in range(80):
        parts = [words(rng.randrange(0, 30))]
        if i % 3 == 0:
            parts += [rng.choice(items)[1] or "", words(5)]
        texts.append(rng.choice([" ", "--", "\n"]).join(parts).upper() if i % 2 else " ".join(parts))
    texts += [None, "", "a b c", items[5][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"])
           for r in dc.decontaminate(docs, bench, window=window).collect()}
    want = brute.contamination(texts, items, window)
    assert got == dict(enumerate(want))


def test_contamination_of_the_small_tables(spark, small, small_rows):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"])
           for r in dc.decontaminate(small, bench).collect()}
    want = brute.contamination([t for _, t in small_rows], items)
    assert got == {d: w for (d, _), w in zip(small_rows, want)}
    assert any(w[1] for w in want)


def test_contamination_edge_cases(spark, edge):
    bench = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve")],
                                  "item_id bigint, text string")
    rows = dc.decontaminate(edge, bench).collect()
    assert len(rows) == edge.count() and sum(r["n_hit"] for r in rows) == 30
    assert dc.decontaminate(edge.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in dc.decontaminate(edge, bench.limit(0)).collect()} == {0}


def test_selected_fingerprints_cover_every_window():
    from robustq.llm.words import Words
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(rng.choice(list("abc"), n)) for n in (3, 25, 60, 1, 0)])
    w = Words(texts, dc.WORD_TABLE)
    at, _ = dc._selected(w.hashes(), w, 5, 6)
    picked = set(at.tolist())
    for a, b in zip(w.first, w.first[1:]):
        for p in range(int(a), int(b) - 9):
            assert picked & set(range(p, p + 6))


def test_batches_grow_with_the_keys_and_runs_are_deleted(spark, monkeypatch):
    """More keys than a batch holds: several runs, compacted by level, and no table or file is left."""
    from pathlib import Path
    seen = []
    class Runs(ld.LineRuns):
        def _write(self, df):
            name = super()._write(df)
            seen.append((self.folder, name))
            return name
    monkeypatch.setattr(ld, "LineRuns", Runs)
    monkeypatch.setattr(ld, "CORE_ROWS", 4)
    rng = random.Random(3)
    lines = [f"line number {i} of more than forty characters in all" for i in range(40)]
    rows = [(d, "\n".join(rng.sample(lines, 5))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in ld.drop_repeated_lines(docs).collect()}
    assert got == {d: b[2] for (d, _), b in zip(rows, brute.line_dedup(rows))}
    batches = -(-300 // (4 * spark.sparkContext.defaultParallelism))
    assert len(seen) > batches > 4  # every batch a run, every full level one more
    assert not Path(seen[0][0].removeprefix("file:")).exists()
    assert not any(spark.catalog.tableExists(n) for _, n in seen)

    class Dies(Runs):
        def add(self, batch):
            super().add(batch)
            raise RuntimeError("killed")
    monkeypatch.setattr(ld, "LineRuns", Dies)
    seen.clear()
    with pytest.raises(RuntimeError, match="killed"):
        ld.drop_repeated_lines(docs)
    assert not spark.catalog.tableExists(seen[0][1]) and not Path(seen[0][0].removeprefix("file:")).exists()


def test_line_plans_have_no_python(spark):
    docs = spark.createDataFrame([(i, "the same line of more than forty characters, repeated\nx") for i in range(9)],
                                 "doc_id bigint, text string")
    plan = ld.drop_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
