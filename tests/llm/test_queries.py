"""The registered queries without an SQL form, over the whole small tables, against brute force."""

import pytest

from robustq.llm import queries as q
from tests.conftest import SF_SMALL
from tests.llm import brute


def _rows(spark, name):
    return {r["doc_id"]: r for r in q.QUERIES[name](spark, SF_SMALL).collect()}


def test_all_queries_are_registered():
    import __spark_entry__ as entry
    assert sorted(int(k[2:].split("_")[0]) for k in q.QUERIES) == list(range(1, 14))
    assert set(q.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_op2(spark, small_rows):
    got = _rows(spark, "op2_quality_rules")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for d, t in small_rows:
        assert tuple(got[d][c] for c in cols) == brute.base_counts(t)
        assert not (got[d]["base_failed"] and got[d]["kept"])


def test_op2_keeps_by_counted_ratios(spark, small):
    """score and kept of every document from n-gram arrays counted in Python."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from robustq.llm import quality_llr as llr
    good = spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("quality = 1")
    buckets = llr.log_ratios(small, good)[1]
    trusted = {r["doc_id"] for r in good.collect()}
    grams = {r["doc_id"]: r["g"] for r in small.select(
        "doc_id", llr.ngram_buckets(F.col("text"), buckets).alias("g")).collect()}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        target.update(g if d in trusted else [])
    nr, nt = sum(raw.values()) + buckets, sum(target.values()) + buckets
    got = _rows(spark, "op2_quality_rules")
    for d, g in grams.items():
        want = sum(math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr) for b in g) / len(g) if g else 0.0
        assert got[d]["score"] == pytest.approx(want, abs=1e-8)
        if abs(want - llr.THRESHOLD) > 1e-6:
            assert got[d]["kept"] == (not got[d]["base_failed"] and want >= llr.THRESHOLD)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op1_license_scan"])
def test_native_plans_have_no_python(spark, name):
    p = q.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Pandas", "Arrow"))


def test_op3(spark, small_rows):
    got = _rows(spark, "op3_simhash_near_dedup")
    fps = [(d, brute.fingerprint(t)) for d, t in small_rows]
    comp = brute.components(fps)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {
        d: (f"{f:016x}", comp[d]) for d, f in fps}


def test_op4(spark, small_rows):
    got = _rows(spark, "op4_suffix_array_dedup")
    want = brute.spans([(t or "").encode() for _, t in small_rows], 400)
    assert any(w[0] for w in want)
    for (d, t), (removed, runs, kept) in zip(small_rows, want):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len((t or "").encode()), removed, runs, brute.sha(kept))


def test_op9(spark, small_rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(q.tokenizer_path())
    got = _rows(spark, "op9_bpe_encode_decode")
    for d, x in small_rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        r = got[d]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), brute.sha(" ".join(map(str, ids))),
            brute.sha(t.decode(ids, skip_special_tokens=False)))


def test_op7_of_an_empty_table(spark, tmp_path):
    """Only the added conversation is left."""
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").limit(0)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = q.QUERIES["op7_chat_formatting"](spark, str(tmp_path)).collect()
    said = "</s>[INST] ok [/INST]"
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(-7, 2, len(said))]
    assert got[0]["turns_sha256"] == brute.sha(f"user\n{said}\nassistant\n{said}\n")
    assert got[0]["loss_sha256"] == brute.sha(said)


def test_op10_columns_follow_the_model(spark, small):
    """held_out, score and predicted of every row from a model fitted apart."""
    import zlib

    import pyarrow as pa
    from pyspark.sql import functions as F

    from robustq.llm import mil_quality as mil
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality")
    model = mil.fit(small, labels, F.coalesce(q.part_of(5) != 0, F.lit(False)))
    got = _rows(spark, "op10_quality_classifier")
    for r in small.select("doc_id", "text").collect():
        score = float(mil.predict(model, pa.array([r["text"]], pa.string()))[0])
        row = got[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert row["score"] == pytest.approx(score, abs=1e-9) and row["predicted"] == int(row["score"] >= 0.3)


def test_op8_columns_follow_the_parse(spark, small):
    """held_out, lang_pred and score of every row from a model fitted apart and counted phrases."""
    import zlib

    from robustq.llm import language_id as lang
    model = q.language_model(small)
    got = _rows(spark, "op8_language_id")
    for r in small.select("doc_id", "text").collect():
        names, scores = lang.predict(model, [r["text"]])
        row = got[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert row["lang_pred"] == names[0] and row["score"] == pytest.approx(scores[0])
