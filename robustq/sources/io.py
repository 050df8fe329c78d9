"""Sources and sinks (A): TSV pairs, JSONL facts, label-token maps, result summaries.

Writers target a folder the caller names; :func:`scratch_dir` derives one from the
cluster's ``spark.checkpoint.dir`` (shared storage), never a machine-local temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from robustq.session import ensure_checkpoint_dir
from robustq.sources.committed import committed_paths, write_committed

# fixed values: the TSV dialect of the shipped pair files. White space and empty strings stay
# as they are (an empty string is written quoted, a null as ``NULL_MARK``).
NULL_MARK = "\\N"
TSV_OPTIONS = dict(sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                   ignoreTrailingWhiteSpace=False, nullValue=NULL_MARK)
NA = "n/a"  # del_idx of the unperturbed variant in summaries

PAIRS_SCHEMA = T.StructType([
    T.StructField("ex_id", T.StringType()),
    T.StructField("sentence_a", T.StringType()),
    T.StructField("sentence_b", T.StringType()),
    T.StructField("label", T.StringType()),
])

# fixed values: record and column names of the facts and result files
EVIDENCE = T.StructType([T.StructField("obj_surface", T.StringType()),
                         T.StructField("masked_sentence", T.StringType())])
FACTS_SCHEMA = T.StructType([
    T.StructField("sub_label", T.StringType()),
    T.StructField("obj_label", T.StringType()),
    T.StructField("evidences", T.ArrayType(EVIDENCE)),
])

SUMMARY_SCHEMA = T.StructType([
    T.StructField("exp_name", T.StringType()), T.StructField("task", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("seed", T.IntegerType()),
    T.StructField("template", T.StringType()), T.StructField("acc", T.DoubleType()),
    T.StructField("del_idx", T.StringType()), T.StructField("n_del", T.IntegerType()),
    T.StructField("n_examples", T.LongType()),
])
# the MP family also names the training size of each run
MP_SUMMARY_SCHEMA = T.StructType([*SUMMARY_SCHEMA.fields[:4], T.StructField("dp", T.IntegerType()),
                                  *SUMMARY_SCHEMA.fields[4:]])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/robustq-io/{name}-{uuid.uuid4().hex}"


# -- A1 -----------------------------------------------------------------------------
def read_pairs(spark: SparkSession, path: str, schema: T.StructType = PAIRS_SCHEMA,
               multi_line: bool = False) -> DataFrame:
    """Read tab-separated pairs with a header and doubled-quote escaping; columns not in
    ``schema`` (stray index columns) are ignored by name. ``multi_line``: fields may hold line
    breaks; a file is then read by one task."""
    raw = spark.read.options(**TSV_OPTIONS, multiLine=multi_line).option("inferSchema", False).csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_pairs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**TSV_OPTIONS, emptyValue='""').csv(path)


# -- A2 -----------------------------------------------------------------------------
def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with nested evidences -> one row per evidence (flat)."""
    d = spark.read.schema(FACTS_SCHEMA).json(path)
    return d.select("sub_label", "obj_label", F.explode_outer("evidences").alias("e")) \
        .select("sub_label", "obj_label", "e.obj_surface", "e.masked_sentence")


def write_facts(flat: DataFrame, path: str, chunk: int = 64, id_col: str = "ev_id") -> None:
    """Nest flat evidence rows into JSONL records. A fact is split into records of at most
    ``chunk`` evidences (grouped by ``id div chunk`` on a unique evidence id), so one hot
    fact never becomes one unbounded row."""
    g = (flat.groupBy("sub_label", "obj_label", F.floor(F.col(id_col) / chunk).alias("_c"))
         .agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("_id"), "obj_surface",
                                                   "masked_sentence"))).alias("_ev")))
    out = g.select("sub_label", "obj_label",
                   F.transform("_ev", lambda e: F.struct(e["obj_surface"].alias("obj_surface"),
                                                         e["masked_sentence"].alias("masked_sentence")))
                   .alias("evidences"))
    out.write.mode("overwrite").json(path)


# -- B4: rows that cannot be read ------------------------------------------------------
CORRUPT = "_unreadable"


def read_pairs_checked(spark: SparkSession, path: str, schema: T.StructType = PAIRS_SCHEMA,
                       names: list[str] | None = None) -> DataFrame:
    """As :func:`read_pairs`, but a line that is no row of the file's columns is kept in
    ``_unreadable`` (else null) instead of being bent to fit. The columns are those of the header,
    or ``names`` for files without one."""
    options = TSV_OPTIONS | {"header": names is None}
    if names is None:
        names = spark.read.options(**options).option("inferSchema", False).csv(path).columns
    full = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(CORRUPT, T.StringType())])
    # without pruning: a parser that skips columns does not see how many fields a line has
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False) \
        .schema(full).csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], CORRUPT)


def unreadable_pairs(required: tuple[str, ...] = ("label",)) -> dict[str, Column]:
    """Reject rules for :func:`robustq.operators.prepare.split_valid`: an odd number of quotes leaves
    a field open; any other line that is no row has too few or too many fields."""
    line = F.col(CORRUPT)
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return {"open_quote": line.isNotNull() & odd, "field_count": line.isNotNull(),
            **{f"no_{c}": F.col(c).isNull() for c in required}}


def read_facts_checked(spark: SparkSession, path: str) -> DataFrame:
    """Nested fact records; a line that is no such record is kept in ``_unreadable``."""
    full = T.StructType([*FACTS_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", CORRUPT).json(path)


def unreadable_facts() -> dict[str, Column]:
    line = F.col(CORRUPT)
    cut = ~F.rtrim(line).endswith("}")
    return {"cut_short": line.isNotNull() & cut, "not_a_record": line.isNotNull(),
            "no_evidences": F.coalesce(F.size("evidences"), F.lit(-1)) <= 0}


# fixed values: input suffix -> reader (A3 dispatch)
READERS = {".tsv": "pairs", ".jsonl": "facts", ".json": "facts"}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader from the file suffix (.tsv pairs, .jsonl/.json facts); an unknown
    suffix is an error."""
    for suffix, kind in READERS.items():
        if path.rstrip("/").endswith(suffix):
            return read_pairs(spark, path) if kind == "pairs" else read_facts(spark, path)
    raise ValueError(f"no reader for {path}")


# -- A4 / A6 ------------------------------------------------------------------------
def label_map_json(labelmap: DataFrame) -> DataFrame:
    """(label, pos, token) -> one row with a JSON object {label: [tokens in rank order]}.
    The map has one entry per class (bounded)."""
    per = labelmap.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"])
        .alias("tokens"))
    return per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "tokens"))))
                   .alias("json"))


def label_tokens(map_json: DataFrame, n: int = 3, col: str = "json") -> DataFrame:
    """A4: parse {label: [ranked tokens]} and keep the first ``n`` per label."""
    m = map_json.select(F.from_json(col, "map<string,array<string>>").alias("m"))
    e = m.select(F.explode("m").alias("label", "tokens"))
    return e.select("label", F.posexplode(F.slice("tokens", 1, n)).alias("pos", "token"))


def write_label_tokens(labelmap: DataFrame, path: str, run: str = "labels") -> None:
    """One ranked token folder per class plus the combined JSON map, published together."""
    def write(folder: str) -> None:
        labelmap.write.partitionBy("label").parquet(f"{folder}/per_label")
        label_map_json(labelmap).write.text(f"{folder}/label_map_json")
    write_committed(labelmap.sparkSession, path, run, write)


def read_label_tokens(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    folders = committed_paths(spark, path)
    per = spark.read.parquet(*[f"{f}/per_label" for f in folders]).select("label", "pos", "token")
    js = spark.read.text([f"{f}/label_map_json" for f in folders]).withColumnRenamed("value", "json")
    return per, js


# -- A5 -----------------------------------------------------------------------------
def write_summary(results: DataFrame, path: str, run: str = "results") -> None:
    """Result rows as TSV with header, one folder per (task, model), published whole as ``run``
    (written again, a run takes its own place; other runs of ``path`` stay). NULL del_idx is
    written as 'n/a' like the reference summaries."""
    write_committed(results.sparkSession, path, run, lambda folder: results.write.partitionBy("task", "model")
                    .options(**TSV_OPTIONS | {"nullValue": NA}).csv(folder))


def read_summary(spark: SparkSession, path: str, schema: T.StructType = SUMMARY_SCHEMA) -> DataFrame:
    """Re-read the published summaries of all runs; 'n/a' becomes NULL (so the baseline drops out
    of del_idx groups)."""
    read = spark.read.options(**TSV_OPTIONS | {"nullValue": NA}).option("inferSchema", False)
    # every run is a table of its own with its partition folders
    raw, *others = [read.csv(p) for p in committed_paths(spark, path)]
    for other in others:
        raw = raw.unionByName(other)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# -- A3 -----------------------------------------------------------------------------
def resolve_split(registry: DataFrame, family: str, task: str, eval_type: str) -> str:
    """Dataset of an evaluation type in a split registry (family, task, eval_type, ds); an
    unknown combination is an error."""
    rows = (registry.filter((F.col("family") == family) & (F.col("task") == task)
                            & (F.col("eval_type") == eval_type)).select("ds").distinct().limit(2).collect())
    if len(rows) != 1:
        found = "several datasets are" if rows else "no dataset is"
        raise ValueError(f"{found} registered for the {family} evaluation {eval_type!r} of {task!r}")
    return rows[0]["ds"]
