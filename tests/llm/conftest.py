import pytest

EDGE = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b\x0c\r ", "fr", "b", 7),
    (6, "Ünïcode 漢字 🙂 <|endoftext|> </s>[INST] x [/INST] \\ \x01\x1c", None, "c", 5),
    (7, "word", "de", "c", 4),
    (8, "long " * 30_000 + "tail", "en", "c", 9),
    (9, "x" * 50_000, "en", "c", 9),
    (None, "no id but a text of some words", "en", None, 3),
    (10, "\n".join(["the same line of more than forty characters, repeated"] * 3), "en", "d", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with
    names that the operators use."""
    df = spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string, source string, "
                                     "n_chars bigint")
    for c in ("id", "th", "_row", "__x", "fp", "spans", "n_words", "score", "lang_pred", "kept",
              "n_lines", "drop"):
        df = df.selectExpr("*", f"'clash' as `{c}`")
    return df


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
