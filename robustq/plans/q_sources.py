"""Queries A1-A6 (sources and sinks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustq.functions.hashing import hnum, sql_hnum
from robustq.operators.prepare import split_valid
from robustq.plans import experiments as ex
from robustq.plans import fixtures as fx
from robustq.plans import oracle_eval as oe
from robustq.plans.oracle_views import with_views
from robustq.plans.registry import register
from robustq.sources import io

# -- A1 -----------------------------------------------------------------------------


@register("tsv_pairs", with_views(["v1a"], "SELECT * FROM v1a"))
def tsv_pairs(spark, sf):
    """V1 written as TSV (header, doubled quotes) and read back whole."""
    path = io.scratch_dir(spark, "pairs")
    io.write_pairs(fx.docs_pairs(spark, sf, labelled=False), path)
    return io.read_pairs(spark, path)


# -- A2 -----------------------------------------------------------------------------
@register("jsonl_facts", with_views(["v3"], "SELECT sub_label, obj_label, obj_surface, masked_sentence FROM v3"))
def jsonl_facts(spark, sf):
    """V3 nested into JSONL fact records and read back as one row per evidence."""
    path = io.scratch_dir(spark, "facts")
    io.write_facts(fx.facts(spark, sf), path)
    return io.read_facts(spark, path)


# -- A3 -----------------------------------------------------------------------------
# fixed values: eval types and where they resolve (task = the task itself, other = the
# other task, adv_* = the task's adversarial sets); MP has no original-acc entry
EVAL_TYPES = [
    ("token_reordering", "task"),
    ("token_deletion", "task"),
    ("original-acc", "task"),
    ("adversarial_perturbation_label_no_change", "adv_no_change"),
    ("adversarial_perturbation_label_change", "adv_change"),
    ("no_adversarial_perturbation", "adv_original"),
    ("cross_dataset", "other"),
]
TASKS = {"docs": "turns", "turns": "docs"}


def manifest_rows():
    rows = []
    for family in ("ap", "mp"):
        for task, other in TASKS.items():
            for et, target in EVAL_TYPES:
                if family == "mp" and et == "original-acc":
                    continue
                ds = task if target == "task" else other if target == "other" else f"{task}_{target}"
                rows.append((family, task, et, ds))
    return rows


# the manifest spelled out for the SQL side (not built from the list above)
_MANIFEST_SQL = """
    SELECT family, task, eval_type,
           CASE WHEN eval_type = 'cross_dataset' THEN CASE task WHEN 'docs' THEN 'turns' ELSE 'docs' END
                WHEN eval_type LIKE 'adversarial%no_change' THEN task || '_adv_no_change'
                WHEN eval_type LIKE 'adversarial%change' THEN task || '_adv_change'
                WHEN eval_type = 'no_adversarial_perturbation' THEN task || '_adv_original'
                ELSE task END AS ds
    FROM (VALUES ('ap'), ('mp')) f(family), (VALUES ('docs'), ('turns')) t(task),
         (VALUES ('token_reordering'), ('token_deletion'), ('original-acc'),
                 ('adversarial_perturbation_label_no_change'), ('adversarial_perturbation_label_change'),
                 ('no_adversarial_perturbation'), ('cross_dataset')) e(eval_type)
    WHERE NOT (family = 'mp' AND eval_type = 'original-acc')"""


_STATS = """SELECT ds, count(*) AS n_rows,
       sum(CASE WHEN label = 'entailment' THEN 1 ELSE 0 END) AS n_entailment,
       sum(CASE WHEN label = 'contradiction' THEN 1 ELSE 0 END) AS n_contradiction,
       sum(CASE WHEN label = 'neutral' THEN 1 ELSE 0 END) AS n_neutral
FROM (SELECT 'docs' AS ds, label FROM v1 UNION ALL SELECT 'turns', label FROM v2
      UNION ALL SELECT 'docs_adv_' || set, label FROM v6
      UNION ALL SELECT 'turns_adv_' || set, label FROM v6t) u GROUP BY ds"""


@register("split_registry", with_views(
    ["v1", "v2", "v6", "v6t"],
    """SELECT m.family, m.task, m.eval_type, m.ds, CAST(s.n_rows AS BIGINT) AS n_rows,
              CAST(s.n_entailment AS BIGINT) AS n_entailment,
              CAST(s.n_contradiction AS BIGINT) AS n_contradiction,
              CAST(s.n_neutral AS BIGINT) AS n_neutral
       FROM m LEFT JOIN s ON s.ds = m.ds""",
    [("m", _MANIFEST_SQL), ("s", _STATS)]))
def split_registry(spark, sf):
    """(family, task, eval_type) -> dataset with its row and label counts."""
    man = spark.createDataFrame(manifest_rows(), "family string, task string, eval_type string, ds string")
    from robustq.functions.materialize import materialize_all
    # each task is read twice (its own rows and its adversarial sets): written once,
    # the two tasks at the same time
    v1, v2 = materialize_all(fx.docs_pairs(spark, sf), fx.turn_pairs(spark, sf))
    parts = [v1.select(F.lit("docs").alias("ds"), "label"), v2.select(F.lit("turns").alias("ds"), "label"),
             fx.adversarial(v1).select(F.concat(F.lit("docs_adv_"), "set").alias("ds"), "label"),
             fx.adversarial(v2).select(F.concat(F.lit("turns_adv_"), "set").alias("ds"), "label")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    stats = u.groupBy("ds").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(F.when(F.col("label") == lab, 1).otherwise(0)).cast("bigint").alias(f"n_{lab}")
          for lab in ("entailment", "contradiction", "neutral")])
    return man.join(stats, "ds", "left").select(
        "family", "task", "eval_type", "ds", "n_rows", "n_entailment", "n_contradiction", "n_neutral")


# -- A4 -----------------------------------------------------------------------------
@register("label_token_map", with_views(["v5l"], "SELECT label, pos, token FROM v5l WHERE pos < 3"))
def label_token_map(spark, sf):
    """Label map serialised as {label: [ranked tokens]} JSON, parsed, first 3 kept."""
    js = io.label_map_json(fx.label_words(spark, sf))
    return io.label_tokens(js, n=3)


# -- A5 -----------------------------------------------------------------------------
@register("summary_sink", with_views(
    ["v1", "v5t", "seeds", "labels_c"],
    "SELECT exp_name, task, model, seed, template, acc, del_idx, n_del, n_examples FROM d_res",
    oe.experiment("d", "v1", oe.deletion_variants("v5t"), "docs")))
def summary_sink(spark, sf):
    """Deletion results written as TSV summaries (per task/model) and re-read."""
    v1, trig = fx.grid_inputs(spark, sf)
    res = ex.evaluate(v1, ex.ap_deletion_variants(trig), "docs", materialized=True)
    path = io.scratch_dir(spark, "summary")
    io.write_summary(res, path)
    return io.read_summary(spark, path)


# -- A6 -----------------------------------------------------------------------------
@register("label_token_sink", with_views(["v5l"], "SELECT label, pos, token FROM v5l"))
def label_token_sink(spark, sf):
    """Ranked label tokens written one folder per class (+ JSON map) and re-read."""
    path = io.scratch_dir(spark, "labels")
    io.write_label_tokens(fx.label_words(spark, sf), path)
    per, js = io.read_label_tokens(spark, path)
    both = io.label_tokens(js, n=fx.LABEL_TOKENS_K).select("label", F.col("pos").cast("int").alias("pos"), "token")
    # rows are returned only if the folders and the JSON map agree on them
    return per.select("label", F.col("pos").cast("int").alias("pos"), "token").join(both, ["label", "pos", "token"])


# -- B4 at read time --------------------------------------------------------------------
def _broken(key: str, n: int = 20):
    return hnum(F.lit("0"), key) % n


def broken_pairs(spark, sf, path):
    """V1 as TSV lines, some of them broken by the hash of their key: the last field missing, one
    too many, a quote that is not closed, no label."""
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
              for c in ("sentence_a", "sentence_b")]
    kind = _broken("ex_id")
    d = fx.docs_pairs(spark, sf)
    whole = F.concat_ws("\t", "ex_id", *quoted, "label")
    line = (F.when(kind == 0, F.concat_ws("\t", "ex_id", *quoted))
            .when(kind == 1, F.concat_ws("\t", "ex_id", *quoted, "label", F.lit("more")))
            .when(kind == 2, F.concat_ws("\t", "ex_id", quoted[0], F.concat(F.lit('"'), F.replace(
                F.col("sentence_b"), F.lit('"'), F.lit(""))), "label"))
            .when(kind == 3, F.concat_ws("\t", "ex_id", *quoted, F.lit(io.NULL_MARK))).otherwise(whole))
    d.select(line.alias("value")).write.mode("overwrite").text(path)


def broken_facts(spark, sf, path):
    """V3 as JSON lines, some cut short, of another kind, without evidences or with none."""
    kind = _broken("ev_id")
    ev = F.array(F.struct("obj_surface", "masked_sentence"))
    none = F.array().cast(ev_type())
    rec = F.to_json(F.struct("sub_label", "obj_label", F.when(kind == 2, none).otherwise(ev).alias("evidences")))
    line = (F.when(kind == 0, F.substring(rec, F.lit(1), (F.length(rec) / 2).cast("int")))
            .when(kind == 1, F.concat(F.lit("{evidences "), F.col("ev_id").cast("string"), F.lit("}")))
            .when(kind == 3, F.to_json(F.struct("sub_label", "obj_label"))).otherwise(rec))
    fx.facts(spark, sf).select(line.alias("value")).write.mode("overwrite").text(path)


def ev_type() -> str:
    return "array<struct<obj_surface:string,masked_sentence:string>>"


def _kind_sql(key: str) -> str:
    return f"{sql_hnum(chr(39) + '0' + chr(39), key)} % 20"


@register("unreadable_rows", with_views(["v1", "v3"], f"""
    SELECT 'pairs' AS source, CASE {_kind_sql('ex_id')} WHEN 0 THEN 'field_count' WHEN 1 THEN 'field_count'
             WHEN 2 THEN 'open_quote' WHEN 3 THEN 'no_label' ELSE 'valid' END AS reason, count(*) AS n
    FROM v1 GROUP BY 2
    UNION ALL
    SELECT 'facts', CASE {_kind_sql('ev_id')} WHEN 0 THEN 'cut_short' WHEN 1 THEN 'not_a_record'
             WHEN 2 THEN 'no_evidences' WHEN 3 THEN 'no_evidences' ELSE 'valid' END, count(*)
    FROM v3 GROUP BY 2"""))
def unreadable_rows(spark, sf):
    """B4 at read time: broken TSV and JSON lines are kept with the reason they were set aside for;
    rows per source and reason."""
    path = io.scratch_dir(spark, "broken")
    broken_pairs(spark, sf, f"{path}/pairs")
    broken_facts(spark, sf, f"{path}/facts")
    pairs = io.read_pairs_checked(spark, f"{path}/pairs", names=io.PAIRS_SCHEMA.fieldNames())
    parts = []
    for source, (ok, bad) in {
            "pairs": split_valid(pairs, io.unreadable_pairs()),
            "facts": split_valid(io.read_facts_checked(spark, f"{path}/facts"), io.unreadable_facts())}.items():
        both = ok.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason"))
        parts.append(both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit(source).alias("source"), "reason", "n"))
    return parts[0].unionByName(parts[1])


# -- A1 with line breaks in fields ------------------------------------------------------
@register("tsv_multiline", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5
    FROM documents""")
def tsv_multiline(spark, sf):
    """Whole texts, line breaks and quotes included, written as quoted TSV and read back by as many
    tasks as the files have splits."""
    from robustq.sources.quoted import read_quoted_pairs
    path = io.scratch_dir(spark, "multiline")
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    io.write_pairs(docs, path)
    back = read_quoted_pairs(spark, path, docs.schema)
    return back.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))
