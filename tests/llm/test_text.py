"""Licence scan, quality rules, chat formatting, language ID, BPE and the quality classifier."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from robustq.llm import bpe_stream as bpe
from robustq.llm import chat_format as chat
from robustq.llm import language_id as lang
from robustq.llm import license_scan as lic
from robustq.llm import mil_quality as mil
from robustq.llm import quality_llr as llr
from robustq.llm import queries as q
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.oracle_check import compare


@pytest.mark.parametrize("key", sorted(q.ORACLE))
def test_matches_duckdb(spark, duckcon, key):
    ok, n, detail = compare(q.QUERIES[key](spark, SF_SMALL), duckcon, q.ORACLE[key])
    assert ok and n > 0, f"{key}: {detail}"


# -- licences -----------------------------------------------------------------------
def test_licence_rules(spark):
    header = """Some words
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
import x"""
    texts = [
        header,
        "no end |\n  Released  under the\nMIT License!\nMore text.",
        lic.SENTENCES["gpl-hope"] + " " + lic.SENTENCES["mit-short"],
        lic.SENTENCES["apache2-grant"],
        "released under the mit license of another kind",
        None, "", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"], r["unmatched"])
           for r in lic.scan(df).collect()}
    assert got[0] == (["apache2-grant", "apache2-copy", "apache2-url", "apache2-asis"],
                      ["Apache-2.0"], [])
    assert got[1] == (["mit-short"], ["MIT"], [])
    assert got[2] == (["gpl-hope", "mit-short"], ["MIT"], ["gpl-hope"])
    assert got[3] == (["apache2-grant"], ["Apache-2.0"], [])
    assert got[4] == got[5] == got[6] == ([], [], [])
    assert got[7] == (["cc-by-nc4"] * 2, ["CC-BY-NC-4.0"], [])


def test_one_text_of_each_licence(spark):
    k = lic.ALL_SENTENCES
    want = {tuple(ids): licence for licence, ids in lic.ALL_RULES}
    texts = ["Some words.\n" + "\n\n".join(k[i] for i in ids) + "\n\nOther words." for ids in want]
    more = [("/* Released under the MIT License. */\nint x;", ["MIT"]),
            ("<!-- SPDX-License-Identifier: BSD-3-Clause -->\n<p>", ["BSD-3-Clause"]),
            ("#!/bin/sh\n# SPDX-License-Identifier: MIT\nset -e", ["MIT"]),
            ("/* SPDX-License-Identifier: GPL-2.0-only */", ["GPL-2.0-only"]),
            ("/*\n * " + k["apache2-asf"] + "\n * " + k["apache2-copy"] + "\n *\n *   "
             + k["apache2-url-https"] + "\n *\n * " + k["apache2-asis"] + "\n */", ["Apache-2.0"]),
            ("Copyright (c) X\n\n" + k["bsd-grant"] + "\n\n1. " + k["bsd-source"] + "\n2. " + k["bsd-binary"]
             + "\n3. " + k["bsd-names"] + "\n\n" + k["bsd-asis"] + " IN NO EVENT", ["BSD-3-Clause"])]
    df = spark.createDataFrame(list(enumerate(texts + [t for t, _ in more])), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lic.scan(df).collect()}
    for i, licences in enumerate([[v] for v in want.values()] + [v for _, v in more]):
        assert (got[i]["licences"], got[i]["unmatched"]) == (licences, []), texts[i] if i < len(texts) else more


def test_unknown_sentences_break_a_sequence(spark):
    k, prose = lic.SENTENCES, "Some words of prose here.\n"
    def text(n):
        return k["apache2-grant"] + "\n" + prose * n + k["apache2-copy"] + "\n\n" + k["apache2-url"]
    df = spark.createDataFrame([(n, text(n)) for n in (0, lic.MAX_GAP, lic.MAX_GAP + 1, 200)],
                               "doc_id bigint, text string")
    got = {r["doc_id"]: (r["licences"], r["unmatched"]) for r in lic.scan(df).collect()}
    near, far = (["Apache-2.0"], []), (["Apache-2.0"], ["apache2-copy", "apache2-url"])
    assert got == {0: near, lic.MAX_GAP: near, lic.MAX_GAP + 1: far, 200: far}


def test_licence_sql_twin_on_generated_texts(spark):
    """Every sentence and rule, comment marks, broken lines, gaps and prose, against DuckDB."""
    import duckdb
    import pandas as pd

    from tests.oracle_check import rows_of
    rng = random.Random(21)
    known = list(lic.ALL_SENTENCES.values())
    lead = ["", "# ", "// ", " * ", "-- ", "; "]

    def piece():
        kind = rng.randrange(8)
        if kind == 0:
            ids = rng.choice(lic.ALL_RULES)[1]
            return rng.choice([" ", "\n", "\n\n"]).join(lic.ALL_SENTENCES[i] for i in ids)
        if kind == 1:
            return "Plain words stand here. " * rng.randrange(9)
        s = rng.choice(known)
        if kind == 2:
            return s.replace(" ", "\n" + rng.choice(lead), rng.randrange(4))
        if kind == 3:
            return f"/* {s} */"
        if kind == 4:
            return f"<!-- {s} -->"
        if kind == 5:
            return s.upper()
        return rng.choice(lead) + s + rng.choice(["", ".", " Then more.", "!"])

    texts = ["".join(piece() + rng.choice(["\n", "\n\n", " ", ". "]) for _ in range(rng.randrange(12)))
             for _ in range(400)] + [None, ""]
    rows = list(enumerate(texts))
    d = lic.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    d = d.select("doc_id", "n_sentences", *[F.array_join(c, ",").alias(c)
                                            for c in ("sentence_ids", "licences", "unmatched")])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    res = con.execute(lic.oracle_sql())
    want = rows_of([c[0] for c in res.description], res.fetchall())
    got = rows_of(d.columns, [tuple(r) for r in d.collect()])
    assert [(a, b) for a, b in zip(got[1], want[1]) if a != b] == [] and got[0] == want[0]
    assert len({r[1] for r in got[1]}) > 30


def test_licence_edge_cases(edge):
    assert lic.scan(edge).count() == edge.count()
    assert lic.scan(edge.limit(0)).count() == 0
    assert {r["n_sentences"] for r in lic.scan(edge, sentences={}).collect()} == {0}


# -- quality rules ------------------------------------------------------------------
def test_base_counts_and_ratios_match_brute_force(spark):
    rng = random.Random(2)
    def text(i):
        w = [rng.choice(["aa", "b", "c#", "d", "Été", "<e>", "漢"]) for _ in range(rng.randrange(60))]
        return rng.choice([" ", "\n", "\t "]).join(w + w[:rng.randrange(20)])
    texts = [text(i) for i in range(60)] + [None, "", " \n\t", "w " * 5000, "x\nx\n \nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    good = df.where("doc_id % 3 = 0").select("doc_id").union(df.limit(1).select("doc_id"))
    rows = {r["doc_id"]: r for r in llr.score(df, good, buckets=64, threshold=0.0).collect()}
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(texts):
        assert tuple(rows[i][c] for c in cols) == brute.base_counts(t)
    grams = {r["doc_id"]: r["g"] for r in
             df.select("doc_id", llr.ngram_buckets(F.col("text"), 64).alias("g")).collect()}
    raw, tgt = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        tgt.update(g if i % 3 == 0 else [])
    nr, nt = sum(raw.values()) + 64, sum(tgt.values()) + 64
    for i, g in grams.items():
        want = sum(math.log((tgt[b] + 1) / nt) - math.log((raw[b] + 1) / nr) for b in g)
        want = want / len(g) if g else 0.0
        assert rows[i]["score"] == pytest.approx(want, abs=1e-9)
        assert rows[i]["kept"] == (not rows[i]["base_failed"] and rows[i]["score"] >= 0)


def test_bigrams_do_not_leave_a_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "")], "doc_id bigint, text string")
    n = {r["doc_id"]: r["n"] for r in
         df.select("doc_id", F.size(llr.ngram_buckets(F.col("text"))).alias("n")).collect()}
    assert n == {1: 3, 2: 1, 3: 0}


def test_buckets_grow_with_the_corpus(spark, monkeypatch):
    assert [llr.bucket_count(n) for n in (0, 32 << 15, (32 << 15) + 1, 10 ** 9)] == \
        [1 << 15, 1 << 15, 1 << 16, 1 << 25]
    monkeypatch.setattr(llr, "BUCKETS", 16)
    df = spark.createDataFrame([(i % 90, " ".join(f"w{i * j % 997}" for j in range(40)) if i else None)
                                for i in range(100)], "doc_id bigint, text string")
    good = df.where("doc_id % 3 = 0").select("doc_id")
    seen = df.select(F.explode(llr.ngram_hashes(F.col("text")))).distinct().count()
    table, buckets = llr.log_ratios(df, good)
    assert 16 < buckets and 0.8 * seen <= 32 * buckets
    one = sorted(map(str, llr.score(df, good).collect()))
    monkeypatch.setattr(llr, "ARRAY_BYTES", 0)
    assert sorted(map(str, llr.score(df, good).collect())) == one
    monkeypatch.setattr(llr, "broadcast_if_bounded", lambda d, width: d)
    assert sorted(map(str, llr.score(df, good).collect())) == one


def test_quality_edge_cases(spark, edge):
    good = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")
    rows = llr.score(edge, good).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["base_failed"] and by[3]["score"] == 0 and by[8]["n_words"] == 30_001
    assert by[8]["base_failed"] and by[8]["n_repeat_words"] == 30_000
    assert llr.score(edge.limit(0), good).count() == 0
    assert {r["score"] for r in llr.score(edge, good.limit(0)).collect()} == {0.0}


def test_quality_rules_keep_the_clean(spark, small):
    rows = q.op2_quality_rules(spark, SF_SMALL)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    got = rows.where("not base_failed").join(labels, "doc_id") \
        .groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r["quality"]: r["k"] for r in got}
    assert share[1] > 0.95 and share.get(0, 0) < 0.5


# -- chat ---------------------------------------------------------------------------
@given(st.text(alphabet="ab\\<|>[]/l\nn漢"), st.text(alphabet="ab\\<|>[]/l\nn"))
def test_rendering_is_reversible(role, text):
    seg, lo, hi = chat.render(role, text)
    assert chat.parse(seg) == (role, text)
    assert chat.escape(text) in seg and chat.unescape(chat.escape(text)) == text
    assert seg.count(chat.TURN) == 1 and seg.count(chat.END) == 1


def test_events_fold_into_final_messages(spark):
    log = [(1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", ""),
           (1, 3, "delta", 1, None, "wr"), (1, 4, "delta", 1, None, "ong"),
           (1, 5, "regenerate", 1, None, None), (1, 6, "message", 1, "assistant", "ri"),
           (1, 7, "delta", 1, None, "ght"), (1, 8, "edit", 0, None, "hello"),
           (1, 9, None, None, None, "new"), (2, 1, "delta", None, "user", "lonely"),
           (None, 1, "message", None, "user", "no conversation"), (2, 2, "edit", 5, "tool", "x")]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, kind string, slot bigint, "
                                    "role string, text string").repartition(3)
    got = sorted(((r["conv_id"] or 0, r["turn"], r["role"], r["text"])
                  for r in chat.fold_log(df).collect()))
    assert got == [(0, 0, "user", "no conversation"), (1, 0, "user", "hello"),
                   (1, 1, "assistant", "right"), (1, 2, "unknown", "new"),
                   (2, 0, "user", "lonely"), (2, 1, "tool", "x")]
    loss = {(r["conv_id"], r["turn"]): r["segment"][r["loss_start"]:r["loss_end"]]
            for r in chat.fold_log(df).where("loss_start is not null").collect()}
    assert loss == {(1, 1): "right"}
    whole = {r["conv_id"]: r["formatted"] for r in
             chat.formatted_text(chat.fold_log(df)).collect()}
    assert whole[1].count(chat.TURN) == 3
    assert chat.fold_log(df.limit(0)).count() == 0


def test_conversation_rows_with_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None),
            (None, 0, "assistant", "x"), (2, 3, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string") \
        .selectExpr("*", "'clash' as kind", "'clash' as seq", "'clash' as segment")
    got = sorted((r["conv_id"] or 0, r["turn"], r["role"], r["text"][:3])
                 for r in chat.format_conversations(df).collect())
    assert got == [(0, 0, "assistant", "x"), (1, 0, "unknown", ""), (1, 1, "user", "a"),
                   (1, 2, "user", "a"), (1, 3, "user", "b"), (2, 0, "assistant", "yyy")]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[2]["loss_chars"] == 100_000 and back[1]["loss_chars"] == 0
    assert back[1]["turns_sha256"] == brute.sha("unknown\n\nuser\na\nuser\na\nuser\nb\n")


def _fold(log):
    """Final messages of one conversation's events, in order."""
    slots = {}
    for _, kind, slot, role, text in log:
        last = max(slots, default=-1)
        if slot is None:
            slot = last + 1 if kind == "message" else max(last, 0)
        if kind == "regenerate":
            slots = {s: v for s, v in slots.items() if s < slot}
        elif kind == "delta":
            old = slots.get(slot, (role, ""))
            slots[slot] = (old[0], old[1] + text)
        else:
            slots[slot] = (slots[slot][0] if kind == "edit" and slot in slots else role, text)
    return [(i, *slots[s]) for i, s in enumerate(sorted(slots))]


@pytest.mark.parametrize("given_slots", ["no", "all", "opens", "mixed"])
def test_one_long_conversation_is_folded_in_many_tasks(spark, monkeypatch, given_slots):
    monkeypatch.setattr(chat, "BLOCK", 8)
    rnd, log = random.Random(given_slots), {}
    for conv, n in ((1, 40), (2, 1500), (None, 300), (3, 60)):
        log[conv] = []
        for i in range(n):
            cuts = given_slots != "opens" and rnd.random() < 0.03
            kind = "regenerate" if cuts else rnd.choice(["message"] * 3 + ["delta", "delta", "edit"])
            slot = rnd.randrange(-2 if given_slots == "mixed" else 0, 5 + i // 3)
            if given_slots == "no" and not cuts or (given_slots != "all" and rnd.random() < 0.5):
                slot = None
            log[conv].append((i, kind, slot, rnd.choice(["user", "assistant"]), f"{i} "))
    rows = [(c, *e) for c, es in log.items() for e in es]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, seq bigint, kind string, slot bigint, "
                                     "role string, text string").repartition(7)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = chat.fold_log(df).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, old)
    for conv, events in log.items():
        mine = sorted((r["turn"], r["role"], r["text"]) for r in got if r["conv_id"] == conv)
        assert mine == _fold(events)
    assert given_slots == "no" or len({r["task"] for r in got if r["conv_id"] == 2}) > 1


def test_rows_of_one_long_conversation_are_folded_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 64)
    df = spark.range(5000).selectExpr("1L as conv_id", "id as turn", "'user' as role",
                                      "concat('t', id) as text")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = chat.format_conversations(df).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, old)
    assert sorted((r["turn"], r["text"]) for r in got) == [(i, f"t{i}") for i in range(5000)]
    assert len({r["task"] for r in got}) > 1


# -- language -----------------------------------------------------------------------
def _parse(sample, seq):
    """Greedy longest matches, character by character."""
    n = at = 0
    while at < len(seq):
        k = 1
        while at + k <= len(seq) and seq[at:at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_cross_parse_matches_brute_force():
    rng = random.Random(4)
    samples = {x: ["".join(rng.choice(a) for _ in range(300))] for x, a in
               (("p", "abc "), ("r", "abcdé"))}
    model = lang.build(samples)
    texts = ["".join(rng.choice("abcdéz ") for _ in range(n)) for n in (1, 5, 80, 300)]
    counts, chars, has = lang.phrases(model, texts, block=64)
    for i, t in enumerate(texts):
        seq = bytes(lang.sequence(lang.code_points(t), model.classes).tolist()) if t else b""
        for j, name in enumerate(model.langs):
            ref = bytes(lang.sequence(lang.code_points(samples[name][0]), model.classes).tolist())
            want = sum(_parse(ref, seq[a:a + 64]) for a in range(0, len(seq), 64))
            if has[i]:
                assert counts[i, j] == want
    assert lang.predict(model, [None, "", "12 !?", " "])[0] == ["und"] * 4


def test_interleaved_rows_are_read_back():
    rng = random.Random(9)
    for width, n in ((5, 300), (60, 500), (900, 200), (3, 1), (4, 0)):
        rows = [{c: rng.randrange(n) for c in rng.sample(range(width), min(width, rng.choice([0, 1, 1, 1, 2, 3, 40])))}
                for _ in range(n)]
        place, cells = lang.interleave(rows, width)
        for r, at in zip(rows, place.tolist()):
            for c in range(width):
                cell = int(cells[at + c])
                assert (cell & 0xFFFFFFFF if cell >> 32 == at else None) == (
                    int(place[r[c]]) if c in r else None)


def test_every_letter_is_a_class_of_its_own():
    """Latin, Greek, Cyrillic and Han together: parses are those of the texts themselves."""
    rng = random.Random(5)
    alphabets = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
                 "zh": "".join(chr(0x4E00 + 7 * i) for i in range(1500))}
    def text(a, n):
        return " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 6))) for _ in range(n))
    samples = {x: [text(a, 900)] for x, a in alphabets.items()}
    model = lang.build(samples)
    seen = {c for t in samples.values() for c in t[0] if c.isalpha()}
    assert len({int(model.classes[ord(c)]) for c in seen}) == len(seen) > 1000
    texts = [text(a, 30) + extra for a in alphabets.values() for extra in ("", " xyzя", "漢θq")]
    counts, _, _ = lang.phrases(model, texts, block=10_000)
    for i, t in enumerate(texts):
        for j, name in enumerate(model.langs):
            assert counts[i, j] == _parse(samples[name][0], t)
    got = lang.predict(model, [text(a, 30) for a in alphabets.values()])[0]
    assert got == list(alphabets)


def test_language_of_long_texts_only_is_learnt(spark):
    long = "\n".join("слово за словом и опять слова" for _ in range(300))
    rows = [(1, long, "ru"), (2, "words after words and again words " * 3, "en"),
            (3, "x" * 9000, "xx"), (4, ("ein wort und noch eins " * 900).strip(), "de"), (5, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lang.fit(df, F.lit(True), sample_chars=2000)
    assert model.langs == ["de", "en", "ru", "xx"]
    assert lang.predict(model, ["опять слова", "again words", "noch ein wort"])[0] == ["ru", "en", "de"]
    cut = {r["doc_id"]: r["p"] for r in df.select("doc_id", lang.passage(F.col("text"), 2000).alias("p")).collect()}
    assert cut[1] + long[len(cut[1]):] == long and cut[1].endswith("слова\n") and 1900 < len(cut[1]) <= 2000
    assert cut[2] == rows[1][1] and cut[3] == "x" * 2000 and cut[4].endswith(" ")


def test_sample_is_the_smallest_hashes(spark):
    rng = random.Random(1)
    rows = [(x, rng.random() < p, rng.randrange(-2 ** 63, 2 ** 63))
            for x, n, p in (("a", 3000, 0.1), ("b", 5, 0.5), ("c", 400, 1.0)) for _ in range(n)]
    df = spark.createDataFrame(rows + rows[:900] * 3, "lang string, long boolean, h bigint")
    got = lang._smallest(df, 40)
    for x in "abc":
        want = sorted({(long, h) for k, long, h in rows if k == x})[:40]
        assert got[x] == want


def test_language_held_out_accuracy(spark, small):
    rows = q.op8_language_id(spark, SF_SMALL).join(small.select("doc_id", "lang"), "doc_id") \
        .where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(edge):
    model = lang.fit(edge, F.lit(True))
    rows = lang.identify(edge, model).collect()
    assert len(rows) == edge.count() and set(edge.columns) == set(rows[0].asDict())
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == "und"
    assert by[8]["lang_pred"] == "en"
    none = lang.fit(edge.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in lang.identify(edge, none).collect()} == {"und"}
    assert lang.identify(edge.limit(0), model).count() == 0


# -- BPE ----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(q.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(q.tokenizer_path())


ODD = ["", "  ", "<|endoftext|>hello<|startoftext|> <|ENDOFTEXT|>", "don't IT'S 'Tis we'll",
       "ΑΣ ΟΔΟΣ Σ", "İstanbul é", "é x\x1cy", "a\x85b\xa0c", "a" * 3000, "ab" * 2000,
       "漢字かな🙂 x́́", "\x00\x01", "ﬁ Å"]


def test_bpe_matches_the_library(vocab, library, small_rows):
    rng = random.Random(1)
    texts = ODD + [t for _, t in small_rows if t]
    texts += ["".join(rng.choice("abcdeinth") for _ in range(9000)),
              "".join(rng.choice("é漢🙂an") for _ in range(2000))]
    enc = bpe.Encoder(vocab)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert enc.ids(t) == want
        assert bpe.decode(vocab, want) == library.decode(want, skip_special_tokens=False)


def test_streaming_equals_merging_at_once(vocab):
    rng = random.Random(8)
    enc = bpe.Encoder(vocab, buffer=vocab.lookahead + 16)
    for alphabet in ("the", "an in re", "ioe", "aA0é"):
        word = [bpe.BYTE_CHAR[b] for b in
                "".join(rng.choice(alphabet.replace(" ", "")) for _ in range(4000)).encode()]
        once = enc._merge([*word[:-1], word[-1] + vocab.suffix])
        assert list(enc.stream(iter(word))) == once
    assert enc.buffer == vocab.lookahead + 16  # it never had to grow


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_is_sufficient(seed):
    """Random merge lists: text up to the bound never changes earlier tokens."""
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    while len(merges) < 14:
        x, y = rng.choice(tokens), rng.choice(tokens)
        if len(x + y) <= 6 and (x, y) not in merges:
            merges.append((x, y))
            if x + y not in tokens:
                tokens.append(x + y)

    class Small:
        ranks = {p: i for i, p in enumerate(merges)}
        lookahead = bpe.sufficient_lookahead(merges)
        added, pattern, suffix = {}, r"\S+", ""
    enc = bpe.Encoder(Small())

    def by_rules(word):  # each rule over the whole word, left to right
        s = list(word)
        for x, y in merges:
            i = 0
            while i + 1 < len(s):
                if s[i] == x and s[i + 1] == y:
                    s[i:i + 2] = [x + y]
                i += 1
        return s

    def stable(tokens, limit):
        at, out = 0, []
        for t in tokens:
            if at + len(t) > limit:
                break
            out.append(t)
            at += len(t)
        return out
    for _ in range(60):
        u = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        v = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))
        full = by_rules(u + v)
        assert enc._merge(list(u + v)) == full
        head = stable(by_rules(u), len(u) - Small.lookahead)
        assert full[:len(head)] == head


def test_incremental_text_decoding(vocab):
    enc, dec = bpe.Encoder(vocab), bpe.TextDecoder(vocab)
    text = "the 漢字 🙂 café <|endoftext|> end"
    out = "".join(map(dec.feed, enc.ids(text))) + dec.close()
    assert out.replace(" ", "") == text.replace(" ", "")


def test_digest_of_the_decoding_machine(vocab, library):
    """The text of the machine fed id by id, over chunks kept and not, and characters cut apart."""
    enc = bpe.Encoder(vocab)
    rng = random.Random(6)
    parts = ["word", "don't", "é", "漢字", "🙂", "<|endoftext|>", "a1b2", "...", " ", "  ", "\n", "x" * 90, "ﷺ"]
    for _ in range(200):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        machine = bpe.TextDecoder(vocab)
        text = "".join(map(machine.feed, enc.ids(t))) + machine.close()
        assert bpe.digest(enc, t)[3] == xxhash.xxh64_hexdigest(text.encode())
    # ids that end within a character: the machine carries it over
    broken = bpe.Encoder(vocab)
    ids = [i for i, tok in vocab.tokens.items() if not tok.endswith("</w>") and tok and not tok.isascii()][:3]
    broken.cache["odd"] = (len(ids), " ".join(map(str, ids)), bpe.decode(vocab, ids), None)
    machine = bpe.TextDecoder(vocab)
    want = "".join(map(machine.feed, [*ids, *enc.ids("word"), *ids, *enc.ids("end")])) + machine.close()
    assert bpe.digest(broken, "odd word odd end")[3] == xxhash.xxh64_hexdigest(want.encode())


def test_bpe_edge_cases(edge, library):
    out = bpe.bpe_digest(edge, q.tokenizer_path())
    rows = out.collect()
    assert len(rows) == edge.count() and set(edge.columns) < set(out.columns)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))
    full = {r["doc_id"]: r for r in bpe.bpe_encode(edge, q.tokenizer_path()).collect()}
    assert full[3]["ids"] == [] and full[7]["ids"] == library.encode("word").ids
    assert bpe.bpe_digest(edge.limit(0), q.tokenizer_path()).count() == 0


def test_short_words_by_numbers(vocab, small_rows):
    """Merging on numbers gives what merging strings gives."""
    enc, rng = bpe.Encoder(vocab), random.Random(12)
    words = {w.encode() for _, t in small_rows for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if len(w.encode()) < 48}
    words |= {bytes(rng.choice(b"abc\xc3\xa9\xff\x00") for _ in range(rng.randrange(1, 48))) for _ in range(500)}
    words |= {b"a" * n for n in range(1, 47)} | {b"ab" * n for n in range(1, 23)}
    for w in sorted(words)[::3]:
        chars = [bpe.BYTE_CHAR[b] for b in w]
        chars[-1] += vocab.suffix
        assert enc._ordinary(w) == [vocab.ids[t] for t in enc._merge(chars) if t in vocab.ids]


def test_cache_is_bounded(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    enc = bpe.Encoder(vocab)
    words = [f"w{i}" for i in range(40)] * 2
    assert enc.ids(" ".join(words)) == bpe.Encoder(vocab).ids(" ".join(words))
    assert len(enc.cache) <= 10 and len(enc.cache.old) <= 10


# -- quality classifier -------------------------------------------------------------
def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 5))
    first, y = np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0])
    p = mil.start_weights(5)
    _, g = mil.gradient(p, x, first, y)
    for k in p:
        for _ in range(4):
            i = tuple(int(rng.integers(n)) for n in p[k].shape)
            old, e = p[k][i], 1e-6
            p[k][i] = old + e
            up = mil.gradient(p, x, first, y)[0]
            p[k][i] = old - e
            down = mil.gradient(p, x, first, y)[0]
            p[k][i] = old
            assert g[k][i] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(1)
    per = rng.integers(2, 9, 200)
    x = rng.normal(size=(per.sum(), 6))
    y = (rng.random(200) < 0.5).astype(float)
    first = np.cumsum(per) - per
    marked = first + rng.integers(0, per)
    x[marked[y == 0], 2] += 5
    m = mil.learn(x, per, y)
    f = mil.forward(m.weights, (x - m.mean) / m.scale, first)
    assert ((f["p"] > 0.5) == (y == 1)).mean() > 0.95
    a = f["a"][marked[y == 0]] * per[y == 0]
    assert np.median(a) > 1.5  # more weight than an even share


def test_passage_features_by_hand():
    x, per = mil.encode(pa.array(["AB cd 12 ##", "", None, " ".join(["w"] * 130)]))
    assert per.tolist() == [1, 0, 0, 3]
    assert x[0][:4].tolist() == [0.25, 0.25, 0.0, 0.25]
    j = len(mil._SETS)
    assert x[1][j + 1] == pytest.approx(63 / 64) and x[3][j] == pytest.approx(1 / 8)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = q.op10_quality_classifier(spark, SF_SMALL).join(labels, "doc_id").where("held_out")
    got = [(r["quality"], r["score"]) for r in rows.collect()]
    good, bad = [s for y, s in got if y == 1], [s for y, s in got if y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert len(got) > 10 and auc > 0.9


def test_repeated_ids_give_one_model(spark, small):
    """Of the texts of one id always the same is learnt from, whatever the order of the rows."""
    docs = small.select((F.col("doc_id") % 60).alias("doc_id"), "text")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    a = mil.fit(docs.repartition(7), labels, F.lit(True))
    b = mil.fit(docs.orderBy("text").coalesce(2), labels, F.lit(True))
    assert np.array_equal(a.mean, b.mean)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_classifier_edge_cases(spark, edge):
    labels = spark.createDataFrame([(1, 1), (8, 0), (8, 0), (9, 0), (9, 1), (3, 1), (None, 0),
                                    (10, None)], "doc_id bigint, quality int")
    model = mil.fit(edge, labels, F.lit(True))
    rows = mil.score(edge, model).collect()
    assert len(rows) == edge.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert mil.score(edge.limit(0), model).count() == 0
    none = mil.fit(edge, labels.limit(0), F.lit(True))
    assert {r["score"] for r in mil.score(edge, none).collect()} == {0.5}


def test_bpe_looks_for_no_cycles_while_it_encodes(spark, monkeypatch):
    """What is kept of a chunk has no cycles; the collector is on again afterwards, errors included."""
    import gc

    from robustq.llm import bpe_stream as bpe
    with bpe.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()
    try:
        with bpe.uncollected():
            raise ValueError
    except ValueError:
        pass
    assert gc.isenabled()


def test_bpe_ordinary_words_start_from_byte_pairs():
    """Ids of short words equal the merges on strings, one-byte words included."""
    from robustq.llm import bpe_stream as bpe
    from robustq.llm.queries import tokenizer_path
    v = bpe.Vocabulary(tokenizer_path())
    e = bpe.Encoder(v)
    assert len(v.pairs) == 256
    for word in ("a", "ab", "the", "streaming", "zzzzqqq", "\u00e9t\u00e9", "antidisestablishmentarianism"):
        sym = [bpe.BYTE_CHAR[b] for b in word.encode()]
        sym[-1] += v.suffix
        want = [v.ids[t] for t in e._merge(sym) if t in v.ids]
        assert e._ordinary(word.encode()) == want
        assert e.ids(word) == want


def test_repeated_halves_alone_are_no_repeated_window(spark):
    """Four or seven words found twice count nothing, eight do; whole windows are made only where a half
    repeats."""
    from robustq.llm import quality_llr as llr
    a, b = [f"a{i}" for i in range(8)], [f"b{i}" for i in range(30)]
    texts = {0: b, 1: a[:4] + b + a[:4], 2: a[:7] + b + a[:7], 3: a + b + a, 4: a[4:] + b + a + a[:4],
             5: ["x"] * 8, 6: ["x"] * 9, 7: []}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "i int, text string")
    got = {r["i"]: r["n"] for r in df.select("i", llr.base_counts(F.col("text"))["w"]["n_repeat_words"].alias("n")).collect()}
    want = {}
    for i, w in texts.items():
        windows = [tuple(w[p:p + 8]) for p in range(len(w) - 7)]
        want[i] = len({q for p, x in enumerate(windows) if windows.count(x) > 1 for q in range(p, p + 8)})
    assert got == want and got[3] == 16 and got[2] == 0
