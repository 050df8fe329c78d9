"""Registered queries of the operators: digest columns derived from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robustq.llm import bpe_stream as _bpe
from robustq.llm import chat_format as _chat
from robustq.llm import decontaminate as _decon
from robustq.llm import fim as _fim
from robustq.llm import language_id as _lang
from robustq.llm import license_scan as _licence
from robustq.llm import line_dedup as _lines
from robustq.llm import mil_quality as _mil
from robustq.llm import packing as _packing
from robustq.llm import quality_llr as _llr
from robustq.llm import simhash_dedup as _simhash
from robustq.llm import suffix_dedup as _suffix
from robustq.llm import vector_codes as _codes
from robustq.llm.common import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def part_of(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n (null: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def language_model(docs: DataFrame) -> _lang.Model:
    """Learnt from the documents that are not held out."""
    return _lang.fit(docs, F.coalesce(part_of(4) != 2, F.lit(False)))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _sha(c):
    return F.sha2(c, 256)


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _licence.scan(documents(spark, sf_dir))
    return d.select("doc_id", "n_sentences",
                    *[F.array_join(c, ",").alias(c)
                      for c in ("sentence_ids", "licences", "unmatched")])


ORACLE["op1_license_scan"] = _licence.oracle_sql()


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return _llr.score(documents(spark, sf_dir), good)


@_query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nd = _simhash.near_duplicates(documents(spark, sf_dir))
    return nd.select("doc_id", _simhash.hex_fp().alias("fingerprint"), "component_id")


@_query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _suffix.remove_repeats(documents(spark, sf_dir))
    return d.select("doc_id", "n_bytes", "n_removed",
                    (F.size("spans") / 2).cast("bigint").alias("n_spans"), "kept_sha256")


@_query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decon.decontaminate(documents(spark, sf_dir),
                             spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    _sha(F.array_join("items", ",")).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op5_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n,
               unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0) t),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n) t),
h AS (SELECT DISTINCT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON iw.g = dw.g AND iw.n = dw.n),
hw AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) t
  GROUP BY r),
hi AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items
  FROM h WHERE item_id IS NOT NULL GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n_hit, 0)::BIGINT AS n_hit,
       coalesce(hi.n_items, 0)::BIGINT AS n_items, sha256(coalesce(hi.items, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.r = d.r LEFT JOIN hi ON hi.r = d.r
"""


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped",
                    _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


ORACLE["op6_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id <> f.owner) AS gone
  FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_model(docs)
    found = _lang.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", F.coalesce(part_of(4) == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


@_query
def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.bpe_digest(documents(spark, sf_dir), tokenizer_path(), carry=["doc_id"])


@_query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"  # fixed value of the contract
    extra = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(said).alias("text")).withColumn("turn", F.col("turn").cast("bigint"))
    return _chat.read_back(_chat.format_conversations(rows.unionByName(extra)))


ORACLE["op7_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(role) + 1 + length(text)
           + length(text) - length(replace(replace(replace(text, chr(92), ''), '<', ''), '[', ''))
           + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@_query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = _mil.fit(docs, labels, F.coalesce(part_of(5) != 0, F.lit(False)))
    d = _mil.score(docs, model, carry=["doc_id"])
    return d.select("doc_id", F.coalesce(part_of(5) == 0, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"])
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                    _sha("output").alias("output_sha256"),
                    _sha(_fim.restore()).alias("restored_sha256"))


ORACLE["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''),
           '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
g AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
p AS (
  SELECT doc_id, t, n,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS a,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS b,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS c,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@_query
def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return _packing.pack(documents(spark, sf_dir), lambda: _packing.library_encoder(path),
                         with_ids=False)


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = _codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    d = _codes.with_label_error(coded)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return d.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error",
                    F.lit(_codes.books_digest(books)).alias("codebooks_sha256"))


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds unrolled over (vector, part, position) rows."""
    ctes = [f"""k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS x,
         len(embedding) // {parts} AS w, row_number() OVER (ORDER BY vec_id) AS r
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            """p AS MATERIALIZED (
  SELECT vec_id, r, (i - 1) // w AS part, (i - 1) % w AS pos, x
  FROM (SELECT vec_id, r, w, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM k) t)""",
            f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS y FROM p WHERE r <= {entries})"]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {entries} + entry)::BIGINT AS m
  FROM (SELECT vec_id, part, entry, sum((x - y) * (x - y))::BIGINT AS d
        FROM p JOIN b{t} USING (part, pos) GROUP BY vec_id, part, entry) t GROUP BY vec_id, part)""")
        if t < rounds:
            ctes.append(f"""b{t + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, b.y)::BIGINT AS y
  FROM b{t} b LEFT JOIN (
    SELECT p.part, m % {entries} AS entry, pos, sum(x)::BIGINT AS s, count(*) AS n
    FROM p JOIN a{t} USING (vec_id, part) GROUP BY p.part, m % {entries}, pos) s
  USING (part, entry, pos))""")
    return "WITH " + ",\n".join(ctes) + f""",
c AS (
  SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code,
         sum(m // {entries})::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id),
l AS (SELECT k.label, sum(error)::BIGINT AS label_error FROM c JOIN k USING (vec_id) GROUP BY k.label)
SELECT c.vec_id, c.code, c.error, l.label_error,
       (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds})
         AS codebooks_sha256
FROM c JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label"""


ORACLE["op12_vector_codes"] = _vector_codes_sql()
