"""Fill-in-the-middle against a plain implementation, on odd texts and random ones."""

import hashlib
import random

import regex
from pyspark.sql import functions as F

from robustq.llm import fim

MARKS = ("<P>", "<S>", "<M>")


def plain_fim(doc_id, text, seed=42):
    """Units by iteration, everything else by string slicing."""
    t = text or ""
    units = [m.group() for m in regex.finditer(fim.UNIT, t)]
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not t or any(m in t for m in MARKS) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    if h4 % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def _check(df, rows):
    out = fim.fill_in_middle(df.select("doc_id", "text"))
    got = sorted(map(repr, (tuple(r) for r in out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
        fim.restore().alias("back")).collect())))
    want = sorted(repr((d, *plain_fim(d, t), t or "")) for d, t in rows)
    assert got == want
    return out


def test_units_are_those_of_iteration():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(" \t\n\x0b\x0c\r\x1c\xa0ab漢🙂<P>") for _ in range(rng.randrange(30)))
        assert fim.unit_ends(t) == [m.end() for m in regex.finditer(fim.UNIT, t)]


def test_edge_rows(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    _check(edge, rows)
    whole = fim.fill_in_middle(edge)
    assert set(edge.columns) <= set(whole.columns) and whole.count() == edge.count()
    none = fim.fill_in_middle(edge.limit(0))
    assert none.count() == 0 and none.columns == whole.columns


def test_forms_and_markers(spark):
    rng = random.Random(11)
    pieces = ["<", "S", ">", "<S", "P>", "<M>", " ", "\n", "word", "wörter", "漢字", "🙂"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(400)]
    out = _check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), rows)
    forms = {r["form"] for r in out.select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_seed_and_columns_of_other_names(spark):
    df = spark.createDataFrame([(7, "a b c d e", "kept")], "key int, body string, form string")
    r = fim.fill_in_middle(df, "body", "key", seed=1, plain_percent=100, spm_percent=0).first()
    want = plain_fim(7, "a b c d e", 1)
    assert r["n"] == 5 and r["form"] == "psm" and r["key"] == 7
    assert r["prefix_chars"] + r["middle_chars"] <= 9 and want[0] == 5


def test_no_shuffle(small):
    plan = fim.fill_in_middle(small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_text(spark):
    t = "unit " * 400_000
    df = spark.range(4).select(F.col("id").alias("doc_id"), F.lit(t).alias("text"))
    for r in fim.fill_in_middle(df).select("doc_id", "n", "form").collect():
        assert (r["n"], r["form"]) == plain_fim(r["doc_id"], t)[:2]
