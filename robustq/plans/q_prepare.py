"""Queries B1-B13 (dataset preparation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustq.functions.hashing import hkey, sql_hkey, sql_hnum
from robustq.functions.materialize import materialize_all
from robustq.functions.ranking import global_position
from robustq.functions.text import sql_words, words
from robustq.operators import prepare as pr
from robustq.plans import fixtures as fx
from robustq.plans.oracle_views import with_views
from robustq.plans.registry import register


@register("standardize_pairs", with_views(
    ["v1a"], "SELECT sentence_a AS premise, sentence_b AS hypothesis, ex_id AS idx, label FROM v1a"))
def standardize_pairs(spark, sf):
    return pr.standardize(fx.docs_pairs(spark, sf, labelled=False))


@register("encode_label_fixed", with_views(
    ["v1", "labels_c"], "SELECT v.ex_id, v.label, c.class_id FROM v1 v JOIN labels_c c ON c.label = v.label"))
def encode_label_fixed(spark, sf):
    return pr.encode_fixed(fx.docs_pairs(spark, sf)).select("ex_id", "label", "class_id")


@register("encode_label_first_seen", with_views(["v1", "v2"], """
    SELECT u.split_ord, u.ex_id, u.label, CAST(f.class_id AS INTEGER) AS class_id
    FROM u JOIN (SELECT label, row_number() OVER (ORDER BY split_ord, ex_id) - 1 AS class_id
                 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY split_ord, ex_id) AS r
                       FROM u) x WHERE r = 1) f ON f.label = u.label""",
    [("u", "SELECT 0 AS split_ord, ex_id, label FROM v2 UNION ALL SELECT 1, ex_id, label FROM v1")]))
def encode_label_first_seen(spark, sf):
    """Class ids by first appearance: turns (split 0) first, then docs (split 1)."""
    # read for the first appearances and for the rows: each table's keys are written once
    v2, v1 = materialize_all(fx.turn_pairs(spark, sf).select(F.lit(0).alias("split_ord"), "ex_id", "label"),
                             fx.docs_pairs(spark, sf).select(F.lit(1).alias("split_ord"), "ex_id", "label"))
    u = v2.unionByName(v1)
    return pr.encode_first_seen(u, ["split_ord", "ex_id"]).select("split_ord", "ex_id", "label", "class_id")


@register("skip_bad_rows", with_views(["v1l"], """
    SELECT reason, count(*) AS n FROM (
      SELECT CASE WHEN l.doc_id IS NULL THEN 'no_label'
                  WHEN len(d.lines) < 2 THEN 'no_sentence' ELSE 'ok' END AS reason
      FROM v1l d LEFT JOIN labels l ON l.doc_id = d.doc_id) t
    GROUP BY reason"""))
def skip_bad_rows(spark, sf):
    """Documents without a label, or without two non-empty lines anywhere in their text, are
    set aside with a reason; counts per reason (ok = kept)."""
    d = fx.docs_lines(spark, sf).select("doc_id", F.size("lines").alias("n"))
    lab = fx.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has_label"))
    j = d.join(lab, "doc_id", "left")
    valid, rejected = pr.split_valid(j, {"no_label": F.col("has_label").isNull(),
                                         "no_sentence": F.col("n") < 2})
    u = valid.select(F.lit("ok").alias("reason")).unionByName(rejected.select("reason"))
    return u.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("sample_limit", with_views(["v1a"], f"""
    SELECT * FROM v1a ORDER BY {sql_hkey("'0'", 'ex_id')}, ex_id LIMIT 50"""))
def sample_limit(spark, sf):
    """A 50-row uniform sample (the sampling operator; the limit is the feature)."""
    return pr.sample_exact(fx.docs_pairs(spark, sf, labelled=False), 50, seed=0)


@register("nested_train_subsets", with_views(["v1a", "seeds"], f"""
    SELECT seed, size, ex_id FROM (
      SELECT s.seed, v.ex_id,
             row_number() OVER (PARTITION BY s.seed ORDER BY {sql_hkey('s.seed', 'v.ex_id')}, v.ex_id) AS rn
      FROM v1a v CROSS JOIN seeds s) x
    JOIN (SELECT unnest([10, 15, 20, 32, 50, 70, 100]) AS size) z ON x.rn <= z.size"""))
def nested_train_subsets(spark, sf):
    return pr.nested_subsets(fx.docs_pairs(spark, sf, labelled=False), fx.SEEDS).select("seed", "size", "ex_id")


@register("holdout_split", with_views(["v1a"], f"""
    SELECT ex_id, CASE WHEN rn <= 50 THEN 'dev' ELSE 'train' END AS split FROM (
      SELECT ex_id, row_number() OVER (ORDER BY {sql_hkey("'0'", 'ex_id')}, ex_id) AS rn FROM v1a) t"""))
def holdout_split(spark, sf):
    """50-row dev set and a disjoint train set (left anti join)."""
    v1 = fx.docs_pairs(spark, sf, labelled=False)
    train, dev = pr.holdout(v1, 50, seed=0)
    return train.select("ex_id", F.lit("train").alias("split")).unionByName(
        dev.select("ex_id", F.lit("dev").alias("split")))


@register("context_pick", with_views(["v3"], f"""
    SELECT sub_label, obj_label,
           replace(arg_min(masked_sentence, h), '[MASK]', arg_min(obj_surface, h)) AS context
    FROM (SELECT *, {sql_hkey("'0'", 'ev_id')} AS h FROM v3) t GROUP BY sub_label, obj_label"""))
def context_pick(spark, sf):
    return pr.pick_context(fx.facts(spark, sf), seed=0)


@register("augment_facts", with_views(["v3"], f"""
    SELECT f.sub_label, l2.obj_label AS obj_label, replace(f.masked, '[MASK]', s.obj_surface) AS context
    FROM pick f
    JOIN lab l ON l.obj_label = f.obj_label
    JOIN lab l2 ON l2.lidx = (l.lidx + 1 + {sql_hnum("'0'", 'f.sub_label', 'f.obj_label')} % ((SELECT count(*) FROM lab) - 1))
                             % (SELECT count(*) FROM lab)
    JOIN ns ON ns.obj_label = l2.obj_label
    JOIN surf s ON s.obj_label = l2.obj_label AND s.sidx = {sql_hnum("'0'", 'f.ev_id')} % ns.n_surf + 1""",
    [("pick", f"""SELECT sub_label, obj_label, arg_min(ev_id, h) AS ev_id,
                         array_to_string(list_slice({sql_words('arg_min(masked_sentence, h)')}, 1, 50), ' ') AS masked
                  FROM (SELECT *, {sql_hkey("'0'", 'ev_id')} AS h FROM v3) t GROUP BY sub_label, obj_label"""),
     ("lab", "SELECT obj_label, row_number() OVER (ORDER BY obj_label) - 1 AS lidx FROM (SELECT DISTINCT obj_label FROM v3) d"),
     ("surf", "SELECT obj_label, obj_surface, row_number() OVER (PARTITION BY obj_label ORDER BY ev_id) AS sidx FROM v3"),
     ("ns", "SELECT obj_label, count(*) AS n_surf FROM v3 GROUP BY obj_label")]))
def augment_facts(spark, sf):
    """One row per fact: its picked context with another label's surface."""
    return pr.swap_objects(fx.facts(spark, sf), seed=0)


@register("vocab_encode", with_views(["v1t", "v4"], """
    SELECT v.ex_id, coalesce(e.ids, []) AS ids FROM v1t v LEFT JOIN (
      SELECT ex_id, list(coalesce(token_id, 3) ORDER BY pos) AS ids FROM (
        SELECT w.ex_id, w.pos, v4.token_id FROM (
          SELECT ex_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos
          FROM (SELECT ex_id, """ + sql_words("text") + """ AS ws FROM v1t) a) w
        LEFT JOIN v4 ON v4.token = w.token) j GROUP BY ex_id) e ON e.ex_id = v.ex_id"""))
def vocab_encode(spark, sf):
    """Words of every whole text -> ids of the document vocabulary (unknown -> 3)."""
    return pr.encode_tokens(fx.docs_texts(spark, sf, rows=True), "text", fx.vocab(spark, sf)).select("ex_id", "ids")


_WAB = sql_words("sentence_a || ' ' || sentence_b")


@register("truncate_head", with_views(["v1a"], f"""
    SELECT ex_id, CAST(len({_WAB}) AS INTEGER) AS n_tokens,
           list_slice({_WAB}, greatest(len({_WAB}) - 255, 1), greatest(len({_WAB}) - 255, 1) + 255) AS tokens
    FROM v1a"""))
def truncate_head(spark, sf):
    """Pair words capped at 256, dropped from the head."""
    d = fx.docs_pairs(spark, sf, labelled=False).select("ex_id", words(F.concat_ws(" ", "sentence_a", "sentence_b")).alias("tokens"))
    return pr.truncate_head(d.withColumn("n_tokens", F.size("tokens")), "tokens").select("ex_id", "n_tokens", "tokens")


@register("batch_pad", with_views(["v1t", "v4"], f"""
    SELECT batch, ex_id,
           list_concat(ids, list_transform(range(m - len(ids)), lambda x: CAST(1 AS BIGINT))) AS ids,
           list_concat(list_transform(range(len(ids)), lambda x: 1), list_transform(range(m - len(ids)), lambda x: 0))
             AS attention_mask
    FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM (
      SELECT CAST((row_number() OVER (ORDER BY {sql_hkey("'0'", 'v.ex_id')}, v.ex_id) - 1) // 32 AS INTEGER) AS batch,
             v.ex_id, coalesce(e.ids, []) AS ids
      FROM v1t v LEFT JOIN (
        SELECT ex_id, list(coalesce(token_id, 3) ORDER BY pos) AS ids FROM (
          SELECT w.ex_id, w.pos, v4.token_id FROM (
            SELECT ex_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos
            FROM (SELECT ex_id, {sql_words('text')} AS ws FROM v1t) a) w
          LEFT JOIN v4 ON v4.token = w.token) j GROUP BY ex_id) e ON e.ex_id = v.ex_id) b) c"""))
def batch_pad(spark, sf):
    """Encoded whole texts in hash-shuffled batches of 32, padded to the batch maximum."""
    from robustq.functions.materialize import concurrently
    v1 = fx.docs_texts(spark, sf, rows=True)
    # the batch order depends on the ids (and the rows of one id) only: number them while the
    # vocabulary is numbered (independent jobs), then join the positions to the encoded rows
    ids = v1.select("ex_id", "_row", hkey(F.lit("0"), "ex_id").alias("_h"))
    voc, pos = concurrently(lambda: fx.vocab(spark, sf),
                            lambda: global_position(ids, ["_h", "ex_id", "_row"], "_p"))
    enc = pr.encode_tokens(v1, "text", voc)
    b = (enc.join(pos.select("_row", "_p"), "_row")
         .withColumn("batch", F.floor(F.col("_p") / 32).cast("int")).drop("_p", "_row"))
    return pr.pad_batches(b, "ids", ["batch"]).select("batch", "ex_id", "ids", "attention_mask")


@register("epoch_batches", with_views(["v1a"], f"""
    SELECT epoch, CAST((rn - 1) // 16 AS BIGINT) AS batch, ex_id FROM (
      SELECT e.epoch, v.ex_id,
             row_number() OVER (PARTITION BY e.epoch ORDER BY {sql_hkey('e.epoch', 'v.ex_id')}, v.ex_id) AS rn
      FROM v1a v CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS epoch) e) t"""))
def epoch_batches(spark, sf):
    """3 epochs over all pairs, reshuffled each, in batches of 16."""
    return pr.epoch_batches(fx.docs_pairs(spark, sf, labelled=False), [0, 1, 2], 16) \
        .select("epoch", "batch", "ex_id")
