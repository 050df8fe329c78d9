"""Packing: every id in exactly one piece, gapless windows, little padding, any partitioning."""

import random
import zlib

import numpy as np
import pytest

from robustq.llm import packing as pk
from robustq.llm import queries as q
from tests.conftest import SF_SMALL


def letters():
    return lambda texts: [[ord(c) for c in t] for t in texts]


def check(rows, docs, size, end_id=0):
    """``docs``: (doc_id, ids without the end id) of every row; ids of equal rows are equal."""
    want = {}
    for d, ids in docs:
        want.setdefault(d, []).append([*ids, end_id])
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    assert set(pieces) == set(want)
    for d, ps in pieces.items():
        got = sorted((s + i, x) for s, ids, _ in ps for i, x in enumerate(ids))
        assert got == sorted((i, x) for ids in want[d] for i, x in enumerate(ids))
        assert {t for _, _, t in ps} == {len(ids) for ids in want[d]}
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = padding = 0
    for ps in seqs.values():
        at = 0
        for off, n in sorted(ps):
            assert off == at
            at += n
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return total, padding


@pytest.mark.parametrize("size,keep,min_piece,fan_in,parts",
                         [(16, 3, 2, 2, 9), (16, 1, 1, 2, 1), (32, 4, 4, 3, 7), (8, 2, 8, 2, 5)])
def test_random_lengths(spark, size, keep, min_piece, fan_in, parts):
    rng = random.Random(size * keep + parts)
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(rng.randrange(3 * size)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = pk.pack(df, letters, size=size, keep=keep, min_piece=min_piece, fan_in=fan_in).collect()
    total, padding = check(got, [(i, [ord(c) for c in t]) for i, t in rows], size)
    assert total == sum(len(t) + 1 for _, t in rows)
    assert padding <= (2 * min_piece - 1) / size * total


def test_packer_is_best_fit_and_bounded():
    p = pk.Packer(10, 3, 2)

    def add(n):
        return [[len(x[3]) for x in w] for w in p.add(n, 0, n, np.zeros(n, np.uint32))]
    assert add(7) == add(8) == add(5) == []
    assert add(2) == [[8, 2]]          # where it leaves least room
    assert add(4) == []                # beside 5, not a new window
    assert add(9) == [] and len(p.windows) == 3
    rng = random.Random(3)
    for _ in range(2000):
        add(rng.randrange(1, 11))
        assert len(p.windows) == len(p.rooms) <= 3


def test_none_fits_fills_the_fullest():
    p = pk.Packer(10, 2, 2)
    for n in (6, 5):
        assert list(p.add(n, 0, n, np.zeros(n, np.uint32))) == []
    out = list(p.add("x", 0, 9, np.zeros(9, np.uint32)))
    # the head of 9 fills 6, its rest fills 5
    assert [[(d, s, len(i)) for d, s, _, i in w] for w in out] == [
        [(6, 0, 6), ("x", 0, 4)], [(5, 0, 5), ("x", 4, 5)]]


def test_fill_exactly_ends_in_powers_of_two():
    w = [[(1, 0, 7, np.arange(7))], [(2, 0, 6, np.arange(6))]]
    out = list(pk.fill_exactly(iter(w), 8))
    assert [sum(len(p[3]) for p in x) for x in out] == [8, 4, 1]
    assert [(p[0], p[1], len(p[3])) for x in out for p in x] == [(1, 0, 7), (2, 0, 1), (2, 1, 4), (2, 5, 1)]


def test_edge_rows(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    enc = pk.library_encoder(q.tokenizer_path("byte_bpe_50k.json"))
    got = pk.pack(edge, lambda: pk.library_encoder(q.tokenizer_path("byte_bpe_50k.json"))).collect()
    docs = [(d, enc([t or ""])[0].tolist()) for d, t in rows]
    assert any(50256 in ids for _, ids in docs)
    check(got, docs, 1024)
    assert pk.pack(edge.limit(0), letters).count() == 0


def test_query_on_the_whole_table(spark, small_rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(q.tokenizer_path("byte_bpe_50k.json"))
    docs = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in small_rows}
    got = q.QUERIES["op13_sequence_packing"](spark, SF_SMALL).collect()
    rows = []
    for r in got:
        ids = np.array(docs[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(ids) == r["ids_crc32"]
        rows.append({**r.asDict(), "ids": ids})
    total, padding = check(rows, [(d, ids[:-1]) for d, ids in docs.items()], 1024)
    assert padding <= 0.01 * total


def test_partitioning_changes_windows_not_pieces_ids(spark, small):
    for n in (1, 13):
        got = pk.pack(small.repartition(n), letters, size=512, fan_in=4, with_ids=False)
        r = got.selectExpr("sum(length) n", "count(distinct doc_id) d").first()
        assert r["d"] == small.count()
        assert r["n"] == small.selectExpr("sum(length(coalesce(text, '')) + 1) n").first()["n"]


def test_encoder_gives_the_library_ids():
    from tokenizers import Tokenizer
    path = q.tokenizer_path("byte_bpe_50k.json")
    t, enc = Tokenizer.from_file(path), pk.ByteBpe(path)
    rng = random.Random(8)
    parts = ["word", "a", "I'll", "n't", "'s", " ", "  ", "\n", "\t", " \n ", "é", "漢字", "🙂", " ", " ",
             "\x1c", "\x85", "́", "ⅷ", "٣", "1,234", "--", "...", "ABC", "᠎", "​", "ß", "<|end", "\x00",
             "oftext|>", "\U0001e4d0", "x-y_z", "(", "'", "\"", "　", "Ωμ", "Жд", "×", "\u0301", "ﬁ"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert enc.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    for x in ("<|endoftext|>", "a <|endoftext|> é", "", "é", " é ", "a é b", "a b é", "é a b"):
        assert enc.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_islands_hold_the_other_characters():
    for x, want in (("abc dé 🙂 ghi jkl", [" dé 🙂 ghi"]), ("🙂", ["🙂"]), ("ab  🙂 c", ["ab  🙂 c"]), ("é b", []),
                    ("", []), ("x y🙂\nz y z", [" y🙂\nz"]), ("a🙂 b🙂 c", ["a🙂 b🙂 c"]), ("q \u2003 r s", ["q \u2003 r"]),
                    ("u🙂v w🙂x y", ["u🙂v", " w🙂x"])):
        spans = list(pk.islands(x))
        assert [x[a:b] for a, b in spans] == want, x
        rest = "".join(x[a:b] for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (len(x), 0)]))
        assert not pk.OTHER.search(rest)
