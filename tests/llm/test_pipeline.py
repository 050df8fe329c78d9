"""The pipeline's rows against brute force, stage by stage."""

import corpus_pipeline as cp
from robustq.llm import queries as q
from tests.conftest import SF_SMALL
from tests.llm import brute


def test_run_matches_brute_force(spark, small):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(q.tokenizer_path())
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    docs = [(d, x) for d, x in docs if x and any(c.isalpha() for c in x)]
    docs = [(d, b[2]) for (d, _), b in zip(docs, brute.line_dedup(docs))]
    comp = brute.components([(d, brute.fingerprint(x)) for d, x in docs])
    docs = [(d, x) for d, x in docs if comp[d] == d]
    items = [(r["item_id"], r["text"]) for r in
             spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = brute.contamination([x for _, x in docs], items)
    want = {}
    for (d, x), b in zip(docs, bad):
        if not b[1]:
            ids = t.encode(x, add_special_tokens=False).ids
            want[d] = (x, len(x), len(ids), brute.sha(" ".join(map(str, ids))),
                       brute.sha(t.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["n_tokens"], r["ids_sha256"],
                         r["decoded_sha256"]) for r in cp.run(spark, SF_SMALL).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, edge, small):
    bare = edge.select(*small.columns)
    for i, (name, stage) in enumerate(cp.STAGES):
        for docs in (bare, bare.limit(0)):
            out = stage(spark, docs, SF_SMALL)
            if i < len(cp.STAGES) - 1:
                assert out.columns == docs.columns, name
            else:
                assert set(docs.columns) < set(out.columns)
            assert out.count() <= docs.count(), name
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup",
                                         "benchmark_decontamination", "bpe_encode_decode"]


def test_null_and_repeated_ids_go_through_row_by_row(spark, small, tmp_path):
    """A contaminated row goes whatever its id; a clean row that shares its id stays."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(q.tokenizer_path())
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    bad = "Some words before it. " + item + " Some words after it."
    clean = [f"plain words number {w} of a text about {w} and nothing that is known elsewhere in {w}"
             for w in ("apples", "rivers", "mountains", "letters")]
    rows = [(None, bad), (None, clean[0]), (5, bad + " again"), (5, clean[1]), (6, clean[2]), (6, clean[2]),
            (7, None), (8, "12 !"), (9, clean[3]), (10, clean[3]), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], small.schema)
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    got = sorted(((r["doc_id"], r["text"], r["n_tokens"]) for r in docs.collect()), key=repr)
    want = [(None, clean[0]), (5, clean[1]), (6, clean[2]), (6, clean[2]), (9, clean[3])]
    assert got == sorted(((d, x, len(t.encode(x, add_special_tokens=False).ids)) for d, x in want), key=repr)


def test_earlier_tables_are_deleted(spark):
    from pathlib import Path
    out = cp.run(spark, SF_SMALL)
    files = [Path(f.removeprefix("file:")) for f in out.inputFiles()]
    assert {p.name for p in files[0].parent.parent.iterdir()} == {"4_bpe_encode_decode"}
