"""Vector codes: trees against exact assignment, whole results against a plain implementation."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from robustq.llm import queries as q
from robustq.llm import vector_codes as vc
from tests.conftest import SF_SMALL


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error), digest, by exact comparisons in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for _, v, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = [nearest(c[p], books[p])[1] for c in cut]
            new.append([])
            for e in range(len(books[p])):
                xs = [c[p] for c, m in zip(cut, mine) if m == e]
                new[p].append(tuple(sum(col) // len(xs) for col in zip(*xs)) if xs else books[p][e])
        books = new
    best = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in b) for b in best]
    by = {}
    for (_, _, lab), e in zip(kept, errors):
        by[lab] = by.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in b), err, by[lab])
            for (i, _, lab), b, err in zip(kept, best, errors)], digest


def run(df, **kw):
    coded, books = vc.compress(df, **kw)
    d = vc.with_label_error(coded)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return sorted(map(repr, (tuple(r) for r in d.select("id", code, "error", "label_error").collect()))), books


@pytest.mark.parametrize("kind", ["normal", "grid", "equal", "clusters"])
@pytest.mark.parametrize("leaf", [1, 4, 24])
def test_tree_assigns_like_exact_comparison(kind, leaf):
    rng = np.random.default_rng(len(kind) + leaf)
    n, d = 700, 4
    pts = {"normal": lambda: rng.normal(0, 4000, (n, d)), "grid": lambda: rng.integers(-2, 3, (n, d)),
           "equal": lambda: np.full((n, d), 7),
           "clusters": lambda: rng.integers(-9, 9, (5, d))[rng.integers(0, 5, n)] * 1000 + rng.integers(-3, 3, (n, d))
           }[kind]().astype(np.int64)
    t = vc.build_tree(pts, leaf)
    # every node covers its points within its radius; children split their parent
    for i in range(len(t.lo)):
        p = t.points[t.lo[i]:t.hi[i]]
        assert (((p - t.centre[i]) ** 2).sum(1) <= t.radius[i] ** 2 * (1 + 1e-12)).all()
        assert (t.total[i] == p.sum(0)).all()
        kids = range(t.first[i], t.last[i])
        if kids:
            assert t.lo[kids[0]] == t.lo[i] and t.hi[kids[-1]] == t.hi[i]
    for entries in (1, 3, 16):
        book = pts[rng.integers(0, n, entries)]  # equal entries: ties
        want = ((pts[:, None] - book[None]) ** 2).sum(2)
        code, err = vc.codes_of(vc.unpack_tree(vc.pack_tree(t)), book)
        assert (code == want.argmin(1)).all() and (err == want.min(1)).all()
        s = vc.sums_of(t, book)
        for e in range(entries):
            assert (s[e, :-1] == pts[code == e].sum(0)).all() and s[e, -1] == (code == e).sum()


def test_subtrees_are_assigned_whole():
    rng = np.random.default_rng(1)
    heads = rng.integers(-9, 9, (4, 8)) * 100_000
    pts = heads[rng.integers(0, 4, 4000)] + rng.integers(-50, 50, (4000, 8))
    t = vc.build_tree(pts)
    single = sum(len(items) for items, _, whole in vc.assign(t, heads) if not whole)
    nodes = sum(len(items) for items, _, whole in vc.assign(t, heads) if whole)
    assert single == 0 and nodes < 100


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    pts = rng.integers(-vc.LIMIT, vc.LIMIT, (50, 8))
    book = pts[:5]
    assert (vc.squared(pts, book) == ((pts[:, None] - book[None]) ** 2).sum(2)).all()


ROWS = [(i, [math.sin(i * 7 + j * j) * (1 + i % 3) for j in range(16)], i % 3 if i % 4 else None) for i in range(90)]


def test_edge_rows(spark):
    bad = [(200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [math.nan] + [0.0] * 15, 1),
           (203, [math.inf] + [0.0] * 15, None), (1, [-math.inf] + [1.0] * 15, 2)]
    odd = [(None, ROWS[3][1], 2), (5, ROWS[5][1], 1), (5, ROWS[6][1], 1), (5, ROWS[5][1], 1)]
    schema = "vec_id bigint, embedding array<float>, label int"
    df = spark.createDataFrame(ROWS + bad + odd, schema).repartition(6)
    for c in ("id", "x", "codes", "error", "_l", "trees"):
        df = df.withColumn(c, F.lit("clash"))
    want, digest = plain_codes(ROWS + odd)
    for block in (7, 4096):
        got, books = run(df, block_rows=block)
        assert got == sorted(map(repr, want)) and vc.books_digest(books) == digest
    # rows of another length and of huge components go
    more = spark.createDataFrame([(300, [1.0] * 8, 1), (301, [], 1), (302, [1e30] + [0.0] * 15, 1),
                                  (303, [1.0] * 3, 1)], schema)
    got, books = run(df.select("vec_id", "embedding", "label").union(more))
    assert got == sorted(map(repr, want)) and vc.books_digest(books) == digest


def test_few_and_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    want, digest = plain_codes(ROWS[:3])
    got, books = run(spark.createDataFrame(ROWS[:3], schema))
    assert got == sorted(map(repr, want)) and vc.books_digest(books) == digest
    got, books = run(spark.createDataFrame([(1, None, 1)], schema))
    assert got == [] and books == []


def test_salted_labels_agree(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "vec_id bigint, embedding array<float>, label int")
    want = run(df)[0]
    monkeypatch.setattr(vc, "broadcast_if_bounded", lambda d, w: d)
    assert run(df)[0] == want


def test_query_against_plain_codes(spark):
    t = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    want, digest = plain_codes([(r["vec_id"], r["embedding"], r["label"]) for r in t.collect()])
    got = q.QUERIES["op12_vector_codes"](spark, SF_SMALL).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}
