"""Fixture views V1-V8 over the test tables, as Spark DataFrames.

Each view has a DuckDB twin in :mod:`robustq.plans.oracle_views`; definitions are in
FIXTURES.md. All views read whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robustq.functions.hashing import hkey
from robustq.functions.materialize import materialize, materialize_all, rows_within, spread
from robustq.functions.ranking import global_position, next_row, row_number_within
from robustq.functions.text import normalize, split_pieces, words

# fixed values
LABELS = ["entailment", "contradiction", "neutral"]  # class ids 0, 1, 2
SEEDS = [0, 1, 2, 3]
TRIGGER_LEN = 10
TRIGGER_POOL = 500          # parameter: triggers are drawn from the most frequent words
LABEL_TOKENS_K = 10         # ranked label tokens kept per label in the label map
RESERVED = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]  # token ids 0..4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_case(toxic: str = "toxic", quality: str = "quality"):
    return (F.when(F.col(toxic) == 1, "contradiction")
            .when(F.col(quality) == 1, "entailment").otherwise("neutral"))


def docs_lines(spark: SparkSession, sf_dir: str, scan: DataFrame | None = None, *carry: str) -> DataFrame:
    """(doc_id, lines): the non-empty whitespace-normalised lines of every document. ``carry``: further
    columns of ``scan`` to keep."""
    d = scan if scan is not None else table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normalize),
                     lambda x: x != "")
    return d.select("doc_id", *carry, lines.alias("lines"))


def docs_pairs(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """V1: (ex_id, sentence_a, sentence_b, label), every two consecutive non-empty lines of
    every document; ``ex_id`` is 'doc_id:position'. ``labelled=False`` keeps the documents
    without a label (label NULL) for the operators that need none."""
    scan = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(x) for x in LABELS])
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", (F.array_position(names, label_case()) - 1).cast("int").alias("cid"))
    # an id and a class number each, broadcast where the counted rows allow it: a shuffle join moves all texts
    lab = F.broadcast(lab) if lab.count() <= rows_within(40) else lab
    # texts get their label and are spread as they are: their pairs hold every line twice
    texts = spread(scan.select("doc_id", "text").join(lab, "doc_id", "inner" if labelled else "left")
                   .select("doc_id", "text", F.get(names, F.col("cid")).alias("label")), source=scan)
    return docs_lines(spark, sf_dir, texts, "label").filter(F.size("lines") > 1) \
        .select("doc_id", "label", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 2)).alias("pos")) \
        .select(F.concat_ws(":", "doc_id", "pos").alias("ex_id"),
                F.get("lines", F.col("pos")).alias("sentence_a"),
                F.get("lines", F.col("pos") + 1).alias("sentence_b"), "label")


def docs_texts(spark: SparkSession, sf_dir: str, rows: bool = False) -> DataFrame:
    """V1t: (ex_id, text), the whole normalised text of every document. ``rows``: with ``_row``,
    the row's place in the scan, which tells rows of one id apart."""
    scan = table(spark, sf_dir, "documents")
    own = [F.monotonically_increasing_id().alias("_row")] if rows else []
    return spread(scan.select(F.col("doc_id").alias("ex_id"), *own,
                              normalize(F.coalesce("text", F.lit(""))).alias("text")), source=scan)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: conversation turn pairs (user->assistant entailment, user->next user neutral,
    first pair of a conversation vs the next conversation's first reply contradiction);
    ``ex_id`` is 'conv_id:turn:kind', unique whatever the number of turns."""
    c = (table(spark, sf_dir, "conversations")
         .select("conv_id", "turn", "role", normalize("text").alias("text")))
    u = c.filter(F.col("role") == "user").alias("u")
    a = c.filter(F.col("role") == "assistant").alias("a")
    # next turn = turn + 1: an equi-join on a near-unique key, no per-conversation window
    ent = (u.join(a, (F.col("u.conv_id") == F.col("a.conv_id"))
                  & (F.col("a.turn") == F.col("u.turn") + 1))
           .select(F.col("u.conv_id").alias("conv_id"), F.col("u.turn").alias("turn"),
                   F.col("u.text").alias("sentence_a"), F.col("a.text").alias("sentence_b")))
    users = c.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    neu = (next_row(users, ["conv_id", "turn"], ["conv_id", "text"])
           .filter(F.col("next_conv_id") == F.col("conv_id"))
           .select("conv_id", "turn", F.col("text").alias("sentence_a"),
                   F.col("next_text").alias("sentence_b")))
    first = (ent.groupBy("conv_id")
             .agg(F.min_by(F.struct("turn", "sentence_a", "sentence_b"), F.col("turn")).alias("f"))
             .select("conv_id", "f.turn", "f.sentence_a", F.col("f.sentence_b").alias("reply")))
    con = (next_row(first, ["conv_id"], ["conv_id", "reply"])
           .filter(F.col("next_conv_id").isNotNull())
           .select("conv_id", "turn", "sentence_a", F.col("next_reply").alias("sentence_b")))

    def tag(df, k, label):
        return df.select(F.concat_ws(":", "conv_id", "turn", F.lit(str(k))).alias("ex_id"),
                         "sentence_a", "sentence_b", F.lit(label).alias("label"))

    return tag(ent, 1, "entailment").unionByName(tag(neu, 2, "neutral")) \
        .unionByName(tag(con, 3, "contradiction"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, flat: one row per evidence (sub_label, obj_label, ev_id, obj_surface,
    masked_sentence). Nested records are made only at the JSONL boundary (A2)."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                               "o_orderstatus")
    # nation is the fixed 25-row dimension: a proven broadcast bound
    j = cu.join(F.broadcast(na), cu.c_nationkey == na.n_nationkey) \
          .join(od, od.o_custkey == cu.c_custkey)
    return j.select(
        F.col("c_name").alias("sub_label"), F.col("n_name").alias("obj_label"),
        F.col("o_orderkey").alias("ev_id"), F.col("n_name").alias("obj_surface"),
        F.concat(F.lit("[MASK] order "), F.col("o_orderkey").cast("string"), F.lit(" "),
                 F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus"))
        .alias("masked_sentence"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, freq) over every word of every document (partial aggregation per task)."""
    # whole texts split into words: heavy per-row work, so a scan with few splits is spread
    # over the cluster first (reading only the first lines, as V1 does, is not worth it)
    d = spread(table(spark, sf_dir, "documents").select("text"))
    return (d.select(F.explode(split_pieces("text")).alias("token")).filter(F.col("token") != "")
            .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: (token, token_id, freq); ids by (freq desc, token) after the 5 reserved ids."""
    wc = word_counts(spark, sf_dir)
    pos = global_position(wc, [F.col("freq").desc(), F.col("token")], "_pos", keys=["freq", "token"])
    return pos.select("token", (F.col("_pos") + len(RESERVED)).alias("token_id"), "freq")


def triggers(spark: SparkSession, sf_dir: str, wc: DataFrame | None = None) -> DataFrame:
    """(seed, tokens[10]) - per seed, the 10 words of the 500 most frequent words with
    the smallest md5(seed:token), in that order. ``wc``: the word counts, when a query has
    already materialised them for another use.

    Four rows read by every branch of a variant grid: written once instead of re-running
    the whole-corpus word count per branch."""
    return materialize(triggers_plan(spark, sf_dir, wc))


def grid_inputs(spark: SparkSession, sf_dir: str, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(V1, triggers), both materialised, at the same time: the V1 scan and the corpus
    word count behind the triggers are independent jobs. ``keep=False``: V1, which holds every line
    twice, is not written; its readers read the documents again."""
    if not keep:
        return docs_pairs(spark, sf_dir), triggers(spark, sf_dir)
    v1, trig = materialize_all(docs_pairs(spark, sf_dir), triggers_plan(spark, sf_dir))
    return v1, trig


def triggers_plan(spark: SparkSession, sf_dir: str, wc: DataFrame | None = None,
                  pool: int = TRIGGER_POOL) -> DataFrame:
    """The plan behind :func:`triggers` (not materialised)."""
    wc = wc if wc is not None else word_counts(spark, sf_dir)
    top = (wc.orderBy(F.col("freq").desc(), F.col("token"))
           .limit(pool))  # top-k report: TakeOrderedAndProject
    s = top.select(F.explode(F.array(*[F.lit(x) for x in SEEDS])).alias("seed"), "token")
    s = s.withColumn("h", hkey("seed", "token"))
    from pyspark.sql import Window
    w = Window.partitionBy("seed").orderBy("h")
    s = s.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= TRIGGER_LEN)
    out = (s.groupBy("seed")
           .agg(F.array_sort(F.collect_list(F.struct("h", "token"))).alias("ts"))
           .select("seed", F.transform("ts", lambda x: x["token"]).alias("tokens")))
    return out


def label_words(spark: SparkSession, sf_dir: str, k: int = LABEL_TOKENS_K,
                pairs: DataFrame | None = None) -> DataFrame:
    """V5b, materialised (see :func:`label_words_plan`): read by several branches."""
    return materialize(label_words_plan(spark, sf_dir, k, pairs))


def label_words_plan(spark: SparkSession, sf_dir: str, k: int = LABEL_TOKENS_K,
                     pairs: DataFrame | None = None) -> DataFrame:
    """Ranked label tokens (label, pos, token). Each word belongs to the label where it
    is most frequent in V1 (ties: lower class id); per label the top k by (count desc,
    token), pos 0-based. ``pairs``: V1, when a query has already materialised it."""
    from pyspark.sql import Window
    v1 = pairs if pairs is not None else docs_pairs(spark, sf_dir)
    cid = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")) - 1
    lw = (v1.select("label", F.explode(split_pieces(F.concat_ws(" ", "sentence_a", "sentence_b")))
                    .alias("token")).filter(F.col("token") != "")
          .groupBy("label", "token").agg(F.count(F.lit(1)).alias("cnt"))
          .withColumn("class_id", cid.cast("int")))
    own = (lw.groupBy("token")
           .agg(F.max_by(F.struct("label", "cnt"), F.struct(F.col("cnt"), -F.col("class_id")))
                .alias("o"))
           .select("token", "o.label", "o.cnt"))
    w = Window.partitionBy("label").orderBy(F.col("cnt").desc(), F.col("token"))
    return (own.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
            .select("label", (F.col("rn") - 1).cast("int").alias("pos"), "token"))


def adversarial(pairs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """V6: (set, ex_id, sentence_a, sentence_b, label) - original, no label change (first two
    words of sentence_b swapped) and label change ('not ' + sentence_b, e->c, c->e, n->e).
    Every input row appears in all three sets. ``carry``: further columns to keep."""
    carry = carry or []
    wb = words("sentence_b")
    swapped = F.when(F.size(wb) >= 2, F.array_join(
        F.concat(F.array(F.get(wb, 1), F.get(wb, 0)), F.slice(wb, 3, F.size(wb) - 2)), " ")
    ).otherwise(F.col("sentence_b"))
    flipped = F.when(F.col("label") == "entailment", "contradiction").otherwise("entailment")
    # one scan: every input row fans out to its three sets
    d = pairs.select(*carry, "ex_id", "sentence_a", "sentence_b", "label",
                     F.explode(F.array(F.lit("original"), F.lit("no_change"), F.lit("change")))
                     .alias("set"))
    st = F.col("set")
    return d.select(
        *carry, "set", "ex_id", "sentence_a",
        F.when(st == "no_change", swapped).when(st == "change", F.concat(F.lit("not "), F.col("sentence_b")))
        .otherwise(F.col("sentence_b")).alias("sentence_b"),
        F.when(st == "change", flipped).otherwise(F.col("label")).alias("label"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: (run, epoch, step, loss) from events; step = rank of event_id within user_id."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id",
                                              F.col("value").alias("loss"))
    r = row_number_within(e, ["run"], ["event_id"], "step")
    return r.select("run", F.floor((F.col("step") - 1) / 10).cast("bigint").alias("epoch"),
                    "step", "loss")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: (vec_id, embedding[64], label)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
