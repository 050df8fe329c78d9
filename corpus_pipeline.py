"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robustq.llm.bpe_stream import bpe_digest
from robustq.llm.common import broadcast_if_bounded, delete_folder, documents, saved, shared_folder
from robustq.llm.decontaminate import decontaminate
from robustq.llm.language_id import identify
from robustq.llm.line_dedup import drop_repeated_lines
from robustq.llm.queries import language_model, tokenizer_path
from robustq.llm.simhash_dedup import keep_first


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars following the text."""
    return df.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c)
                       for c in like.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go."""
    found = identify(docs, language_model(docs))
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(drop_repeated_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. The text alone decides, so rows are told by two hashes of it:
    a null or repeated id neither keeps a contaminated row nor drops a clean one."""
    h1, h2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    keyed = docs.select("text", h1.alias("h1"), h2.alias("h2"))
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["h1", "h2"])
    bad = saved(found.where("n_hit > 0").select("h1", "h2").distinct())
    small = broadcast_if_bounded(bad, 24)
    return docs.join(small, (h1 == small["h1"]) & (h2 == small["h2"]), "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the digests of their encoding and decoding."""
    return bpe_digest(docs, tokenizer_path())


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark), ("bpe_encode_decode", tokens)]

#: Language ID, SimHash components and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage wrote; the tables of earlier stages are deleted when the next
    one is written."""
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark, "pipeline")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            delete_folder(spark, before)
        before = out
    return docs
