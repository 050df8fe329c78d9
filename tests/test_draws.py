"""The vectorised md5 and the orders drawn with it, against hashlib."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from robustq.functions import digests
from robustq.operators import perturb


def hexed(*parts):
    return hashlib.md5(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()


def distinct_order(key, n, number):
    """The order of a number under the keyed bijection, digit by digit."""
    digits, rest = [0] * n, number
    for base in range(1, n + 1):
        digits[n - base], rest = rest % base, rest // base
    for step in range(3 * n):
        at = step % n
        others = ",".join("" if i == at else str(d) for i, d in enumerate(digits))
        digits[at] = (digits[at] + int(hexed(*key, step, others)[:12], 16)) % (n - at)
    left = list(range(n))
    return [left.pop(d) for d in digits]


def test_md5_of_every_length_about_the_block_borders():
    draw = random.Random(0)
    texts = [bytes(draw.randrange(1, 256) for _ in range(n)) for n in [0, 1, 54, 55, 56, 63, 64, 65, 119, 120, 128, 200] * 3]
    width = max(map(len, texts))
    matrix = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
    got = digests.md5(matrix, np.array([len(t) for t in texts]))
    assert [got[:, i].astype("<u4").tobytes() for i in range(len(texts))] == [hashlib.md5(t).digest() for t in texts]


def test_draws_are_those_of_hashlib(spark):
    # long keys (two md5 blocks), a null key part, one token, no tokens, null tokens, long rows
    rows = [("a", 1, list("abcdefghij")), ("k" * 70, 2, list("abc")), (None, 3, list("abcdefghijklm")), ("é", 4, ["x", None]),
            ("e", 5, []), ("f", 6, None), ("g", 7, [f"w{i}" for i in range(120)])]
    df = spark.createDataFrame(rows, "id string, chunk int, tokens array<string>").repartition(2)
    tokens = {(i, c): t for i, c, t in rows}
    key = ("id", "chunk")

    def order(r, *extra):
        t = tokens[r["id"], r["chunk"]]
        return sorted(range(len(t or [])), key=lambda p: hexed(r["id"], r["chunk"], *extra, p))

    got = perturb.reorder_random(df, key=key, reps=3).collect()
    assert len(got) == 3 * len(rows)
    for r in got:
        t = tokens[r["id"], r["chunk"]]
        assert r["tokens"] == [t[p] for p in order(r, r["rep"])]
    deleted = perturb.delete_random(df, key=key, ns=(1, 3), reps=2)
    assert deleted.columns == ["id", "chunk", "tokens", "rep", "n_del", "del_idx"]
    got = deleted.collect()
    assert len(got) == 4 * len(rows)
    for r in got:
        t = tokens[r["id"], r["chunk"]]
        cuts = [order(r, r["rep"], n)[:n] for n in (1, 3)]
        drawn = next(c for c in cuts if "-".join(map(str, c)) == r["del_idx"])
        assert r["n_del"] == len(drawn)
        assert r["tokens"] == (None if t is None else [x for p, x in enumerate(t) if p not in drawn])
    few = df.filter(F.coalesce(F.size("tokens"), F.lit(0)) < 100)
    got = perturb.reorder_distinct(few, key=key, reps=4).collect()
    assert len(got) == 4 + 4 + 4 + 2
    for r in got:
        t = tokens[r["id"], r["chunk"]]
        assert r["tokens"] == [t[p] for p in distinct_order((r["id"], r["chunk"]), len(t), r["rep"])]


def test_draws_run_in_arrow_batches(spark):
    """The draws of a row take no lambda call each (hours of one at a time on a large table)."""
    df = spark.createDataFrame([(0, ["a", "b"])], "seed int, tokens array<string>")
    for f in (perturb.reorder_random, perturb.reorder_distinct, perturb.delete_random):
        plan = f(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "lambdafunction" not in plan


def test_copies_of_a_row_leave_together(spark):
    """All deletions of a row follow each other, whatever their sizes, so that a file packs them against
    each other (sizes apart, its texts were written anew for every size)."""
    rows = [(i, 0, [f"w{i}x{j}" for j in range(n)]) for i, n in enumerate([10, 4, 10, 0, 2, 10, 7])]
    df = spark.createDataFrame(rows, "id int, chunk int, tokens array<string>").coalesce(1)
    got = [r["id"] for r in perturb.delete_random(df, key=("id", "chunk")).collect()]
    assert len(got) == 30 * len(rows)
    assert all(len(set(got[i:i + 30])) == 1 for i in range(0, len(got), 30))


def test_no_deletions_asked(spark):
    df = spark.createDataFrame([(0, ["a", "b"])], "seed int, tokens array<string>")
    assert perturb.delete_random(df, ns=()).collect() == []
