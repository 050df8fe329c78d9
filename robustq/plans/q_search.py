"""Queries G1-G9 (prompt search)."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustq.functions.hashing import sql_hkey, sql_hnum
from robustq.operators import gradient as gr
from robustq.operators import prepare as pr
from robustq.operators import search as se
from robustq.operators.scoring import AdditiveScorer, label_token_ids, predict_from_scores
from robustq.plans import fixtures as fx
from robustq.plans import oracle_eval as oe
from robustq.plans.oracle_views import with_views
from robustq.plans.q_scoring import OWNED_SQL
from robustq.plans.registry import register

# fixed values
BSZ = 16                     # gradient batches
CLASSES, DIMS = list(range(10)), 64   # of the vector table
FIT_STEPS, RATE = 3, 1.0     # full-batch steps that the SQL of the tests unrolls
EPOCHS = 100                 # epochs of the mini-batch fits
N_CAND = 10                  # candidates per flip
SPECIALS = fx.RESERVED

SEQ = ("seq", "SELECT vec_id, embedding, label, vec_id // 10 AS ex, CAST(vec_id % 10 AS INTEGER) AS pos FROM v8")
SUMS = ("sums", f"""SELECT CAST(pos AS INTEGER) AS slot, CAST(d AS INTEGER) AS d, sum(CAST(x AS DOUBLE))
           / (SELECT greatest(1, ceil(count(DISTINCT ex) / {BSZ})) FROM seq) AS g
    FROM (SELECT pos, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM seq) t GROUP BY pos, d""")


CENT = ("cent", """SELECT cls, list(m ORDER BY d) AS centroid FROM (
        SELECT label AS cls, d, avg(CAST(x AS DOUBLE)) AS m FROM (
          SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM v8) t
        GROUP BY label, d) u GROUP BY cls""")
_GATE = f"(1 + 0.5 * cos(CAST(pos * (d + 1) AS DOUBLE))) / {fx.TRIGGER_LEN}"
GRAD = [SEQ, CENT,
        ("gp", f"""SELECT ex, list(s ORDER BY d) AS pooled FROM (
            SELECT ex, d, sum(CAST(x AS DOUBLE) * {_GATE}) AS s FROM (
              SELECT ex, pos, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM seq) t
            GROUP BY ex, d) u GROUP BY ex"""),
        ("gb", f"""SELECT ex, batch, count(*) OVER (PARTITION BY batch) AS size, max(batch) OVER () + 1 AS steps
            FROM (SELECT ex, (row_number() OVER (ORDER BY {sql_hkey("'0'", 'ex')}, ex) - 1) // {BSZ} AS batch FROM gp) t"""),
        ("gl", """SELECT ex, cls, centroid, exp(lg - max(lg) OVER (PARTITION BY ex)) AS e FROM (
            SELECT p.ex, c.cls, c.centroid, list_sum(list_transform(range(len(p.pooled)),
              lambda i: c.centroid[i + 1] * p.pooled[i + 1])) AS lg FROM gp p CROSS JOIN cent c) t"""),
        ("gv", """SELECT d, sum(r * x) AS v FROM (
            SELECT l.ex, unnest(l.centroid) AS x, generate_subscripts(l.centroid, 1) - 1 AS d,
                   (l.share - CASE WHEN l.cls = s.label THEN 1 ELSE 0 END) / b.size / b.steps AS r
            FROM (SELECT ex, cls, centroid, e / sum(e) OVER (PARTITION BY ex) AS share FROM gl) l
            JOIN seq s ON s.ex = l.ex AND s.pos = 0 JOIN gb b ON b.ex = l.ex) t GROUP BY d"""),
        ("grad", f"""SELECT CAST(pos AS INTEGER) AS slot, CAST(d AS INTEGER) AS d, v * {_GATE} AS g
            FROM gv CROSS JOIN (SELECT unnest(range({fx.TRIGGER_LEN})) AS pos) s""")]


def slot_gradients(spark, sf):
    """The loss gradient per slot of the V8 sequences under a fixed model: gates of the fixture,
    class centroids as weights."""
    import numpy as np
    v = fx.vectors(spark, sf)
    cent = sorted((r["cls"], r["centroid"]) for r in se.class_centroids(v).collect())
    gates = gr.wave_gates(fx.TRIGGER_LEN, DIMS)
    model = gr.SlotModel(np.array([c for _, c in cent]), gates, np.zeros(len(cent)), tuple(c for c, _ in cent))
    pooled = gr.pool_sequences(se.sequences(v), gates)
    return gr.slot_gradients(gr.batch_weights(pooled, BSZ), model)


def _softmax_fit(p: str, src: str) -> list[tuple[str, str]]:
    """CTEs of ``FIT_STEPS`` unrolled gradient steps over ``src`` (id, x[], y); the last one,
    ``{p}_w{FIT_STEPS}``, has one row with w, a list of class weight lists."""
    k = len(CLASSES)
    out = [(f"{p}_w0", f"SELECT list_transform(range({k}), lambda c: list_transform(range({DIMS + 1}), "
                       f"lambda i: CAST(0 AS DOUBLE))) AS w")]
    for t in range(FIT_STEPS):
        out.append((f"{p}_p{t}", f"""
            SELECT x, y, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (
              SELECT x, y, list_transform(lg, lambda v: exp(v - list_max(lg))) AS e FROM (
                SELECT x, y, list_transform(w, lambda c: list_sum(list_transform(range({DIMS + 1}),
                         lambda i: c[i + 1] * x[i + 1]))) AS lg
                FROM {src}, {p}_w{t}) a) b"""))
        grads = ", ".join(f"sum((p[{i + 1}] - CASE WHEN y = {c} THEN 1 ELSE 0 END) * v) AS g{i}"
                          for i, c in enumerate(CLASSES))
        new = ", ".join(f"list(w[{i + 1}][d] - {RATE} * g{i} / n ORDER BY d)" for i in range(k))
        out.append((f"{p}_w{t + 1}", f"""
            SELECT [{new}] AS w FROM (
              SELECT d, {grads} FROM (SELECT p, y, unnest(x) AS v, generate_subscripts(x, 1) AS d
                                      FROM {p}_p{t}) q GROUP BY d) g, {p}_w{t}, (SELECT count(*) AS n FROM {src}) c"""))
    return out


_G1 = [("g1x", "SELECT list_concat(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), [CAST(1 AS DOUBLE)]) AS x, "
               "label AS y FROM v8"), *_softmax_fit("g1", "g1x")]


PROJECTION_SQL = with_views(["v8"], f"""
    SELECT CAST(c AS INTEGER) AS cls, list_transform(list_slice(w[c + 1], 1, {DIMS}), lambda v: round(v, 6)) AS weights,
           round(w[c + 1][{DIMS + 1}], 6) AS intercept
    FROM (SELECT w, unnest(range({len(CLASSES)})) AS c FROM g1_w{FIT_STEPS}) t""", _G1)


@register("label_projection")
def label_projection(spark, sf):
    """G1: multinomial logistic regression from V8 vectors to their labels, trained in mini-batches
    to the end (``EPOCHS`` epochs of Adam). No SQL; the first full-batch steps are tested
    against ``PROJECTION_SQL``."""
    w = se.train_projection(fx.vectors(spark, sf), CLASSES, DIMS, EPOCHS)
    return _rounded(w)


def label_projection_full(spark, sf):
    """G1 by full-batch steps, the operator's own number of them; no SQL."""
    return projection_steps(spark, sf)


def projection_steps(spark, sf, **steps):
    return _rounded(se.fit_projection(fx.vectors(spark, sf), CLASSES, DIMS, rate=RATE, **steps))


def _rounded(w):
    return w.select("cls", F.transform("weights", lambda v: F.round(v, 6)).alias("weights"),
                    F.round("intercept", 6).alias("intercept"))


@register("label_tokens_topk", with_views(["v8"], """
    SELECT CAST(cls AS INTEGER) AS cls, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT vec_id, cls, exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY vec_id) AS score
        FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS mx FROM (SELECT v.vec_id, c.cls,
                     list_sum(list_transform(range(len(c.centroid)), lambda i: c.centroid[i + 1] * CAST(v.embedding[i + 1] AS DOUBLE))) AS logit
              FROM v8 v CROSS JOIN cent c) a0) a) b) c
    WHERE rank <= 50""",
    [CENT]))
def label_tokens_topk(spark, sf):
    """Class-centroid weights; per class the 50 tokens with the largest softmax score."""
    v = fx.vectors(spark, sf)
    return se.top_label_tokens(se.class_centroids(v), v, k=50).withColumn("score", F.round("score", 6))


@register("mean_slot_gradient", with_views(["v8"], "SELECT slot, d, round(g, 6) AS g FROM grad", GRAD))
def mean_slot_gradient(spark, sf):
    """The loss gradient at every slot, the mean of each batch of 16 sequences summed over all
    batches and divided by their number."""
    return slot_gradients(spark, sf).withColumn("g", F.round("g", 6))


@register("mean_slot_vectors", with_views(["v8"], "SELECT slot, d, round(g, 6) AS g FROM sums", [SEQ, SUMS]))
def mean_slot_vectors(spark, sf):
    """Per-slot vector sums over all batches of 16 sequences, divided by their number."""
    return se.mean_slot(se.sequences(fx.vectors(spark, sf)), BSZ).withColumn("g", F.round("g", 6))


_EXCLUDED_SQL = f"(list_contains(flatten({OWNED_SQL}), vec_id) OR vec_id IN (0, 1, 2, 3, 4))"


def excluded():
    """Rows of V8 that stand for label and special tokens."""
    return F.array_contains(F.array_union(F.flatten(label_token_ids()), F.sequence(F.lit(0), F.lit(4))),
                            F.col("vec_id").cast("int"))


@register("hotflip_topk", with_views(["v8"], f"""
    SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score
    FROM (SELECT e.vec_id, -sum(CAST(e.x AS DOUBLE) * g.g) AS score
          FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM v8
                WHERE NOT {_EXCLUDED_SQL}) e
          JOIN grad g ON g.d = e.d AND g.slot = 0 GROUP BY e.vec_id) t
    ORDER BY score DESC, vec_id LIMIT {N_CAND}""", GRAD))
def hotflip_topk(spark, sf):
    """Top-10 replacement candidates for slot 0 by -(E . g), label/special ids excluded."""
    g = slot_gradients(spark, sf).filter(F.col("slot") == 0)
    v = fx.vectors(spark, sf).filter(~excluded())
    return se.hotflip(g, v, N_CAND).select("rank", "vec_id", F.round("score", 6).alias("score"))


@register("hotflip_all_slots", with_views(["v8"], f"""
    SELECT slot, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT g.slot, e.vec_id, -sum(CAST(e.x AS DOUBLE) * g.g) AS score
        FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM v8
              WHERE NOT {_EXCLUDED_SQL}) e JOIN grad g ON g.d = e.d GROUP BY g.slot, e.vec_id) t) u
    WHERE rank <= {N_CAND}""", GRAD))
def hotflip_all_slots(spark, sf):
    """G4 for all slots in one scan of the vector table."""
    top = gr.hotflip_all(slot_gradients(spark, sf), fx.vectors(spark, sf), N_CAND, exclude=excluded())
    return top.select("slot", "rank", "vec_id", F.round("score", 6).alias("score"))


_ALLOWED = ("allowed", """SELECT token, token_id, freq FROM v4
    WHERE (length(token) = 1 OR (token NOT IN ('<s>', '<pad>', '</s>', '<unk>', '<mask>')
           AND NOT (upper(left(token, 1)) = left(token, 1) AND lower(left(token, 1)) <> left(token, 1))))
      AND token NOT IN (SELECT token FROM v5l)""")


def allowed(spark, sf):
    from robustq.functions.materialize import concurrently
    # the vocabulary numbering and the label words are independent jobs
    voc, lw = concurrently(lambda: fx.vocab(spark, sf), lambda: fx.label_words(spark, sf))
    return se.allowed_tokens(voc, lw, SPECIALS)


@register("token_filter", with_views(["v4", "v5l"], "SELECT * FROM allowed", [_ALLOWED]))
def token_filter(spark, sf):
    """Vocabulary minus label, special and capitalised tokens (single characters kept)."""
    return allowed(spark, sf)


def candidates(spark, sf, wc=None, lw=None):
    """Top-10 allowed tokens by frequency, for every seed (bounded: seeds x 10).

    Vocabulary ids follow (freq desc, token), so the first ids are a top-k over the word
    counts: no global numbering of the whole vocabulary is needed for them. ``wc``/``lw``:
    word counts and label words a query has already materialised."""
    from pyspark.sql import Window
    order = [F.col("freq").desc(), F.col("token")]
    wc = wc if wc is not None else fx.word_counts(spark, sf)
    lw = lw if lw is not None else fx.label_words(spark, sf)
    top = (se.allowed_tokens(wc, lw, SPECIALS)
           .orderBy(*order).limit(N_CAND))  # TakeOrderedAndProject
    top = top.withColumn("cand_rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    return top.select(F.explode(F.array(*[F.lit(s) for s in fx.SEEDS])).alias("seed"), "cand_rank", "token")


_CAND_VAR = ("c_v", f"""
    SELECT seed, 'cand:' || CAST(seed AS VARCHAR) || ':0' AS variant_id, 0 AS cand_rank, CAST(NULL AS VARCHAR) AS token,
           tokens FROM v5t
    UNION ALL
    SELECT t.seed, 'cand:' || CAST(t.seed AS VARCHAR) || ':' || CAST(c.cand_rank AS VARCHAR), c.cand_rank, c.token,
           list_transform(t.tokens, lambda x, i: CASE WHEN i - 1 = {sql_hnum('t.seed', "'0'")} % 10 THEN c.token ELSE x END)
    FROM v5t t CROSS JOIN (SELECT token, CAST(row_number() OVER (ORDER BY token_id) AS INTEGER) AS cand_rank
                           FROM (SELECT * FROM allowed ORDER BY token_id LIMIT {N_CAND}) a) c""")


def search_inputs(spark, sf):
    """(V1, word counts, label words, triggers), each written once: the search reads V1
    for training, dev and label words, and the word counts for both the triggers and the
    candidates (one whole-corpus count instead of two). Independent tables are written at
    the same time (V1 with the word counts, then the label words with the triggers)."""
    from robustq.functions.materialize import materialize_all
    v1, wc = materialize_all(fx.docs_pairs(spark, sf), fx.word_counts(spark, sf))
    lw, trig = materialize_all(fx.label_words_plan(spark, sf, pairs=v1), fx.triggers_plan(spark, sf, wc))
    return v1, wc, lw, trig


@register("candidate_scores", with_views(
    ["v1", "v4", "v5l", "v5t", "seeds", "labels_c"], """
    SELECT c.seed, c.cand_rank, c.token, c.n_correct, k.n_correct AS cur_correct,
           (c.n_correct > k.n_correct AND row_number() OVER (PARTITION BY c.seed ORDER BY c.n_correct DESC, c.cand_rank) = 1)
             AS accepted
    FROM cnt c JOIN cnt k ON k.seed = c.seed AND k.cand_rank = 0 WHERE c.cand_rank > 0""",
    [_ALLOWED, _CAND_VAR, *oe.scorer("c", "v1", "c_v"),
     ("cnt", """SELECT v.seed, v.cand_rank, v.token, CAST(sum(CAST(p.correct AS INTEGER)) AS BIGINT) AS n_correct
                FROM c_pr p JOIN c_v v ON v.variant_id = p.variant_id GROUP BY v.seed, v.cand_rank, v.token""")]))
def candidate_scores(spark, sf):
    """Correct-count of each candidate flip vs the current trigger over the same examples;
    the best is accepted only if strictly better (first rank wins ties)."""
    v1, wc, lw, trig = search_inputs(spark, sf)
    var = se.candidate_variants(trig, candidates(spark, sf, wc, lw), 0)
    preds = predict_from_scores(AdditiveScorer().score_grid(v1, var))
    counts = preds.groupBy("seed", "cand_rank", "token").agg(F.sum(F.col("correct").cast("int")).alias("n_correct"))
    return se.score_candidates(counts).select("seed", "cand_rank", "token", "n_correct", "cur_correct", "accepted")


ITERS = 300                  # fixed value: iterations of the search
SQL_ITERS = 3                # iterations that the SQL of the tests unrolls
HELD = f"""SELECT ex_id FROM (SELECT ex_id, row_number() OVER (ORDER BY {sql_hkey("'0'", 'ex_id')}, ex_id) AS r
           FROM v1) h WHERE r <= 50"""


def _search_sql() -> list[tuple[str, str]]:
    """The greedy search unrolled: per iteration the gains, the candidates, their counts and
    the accepted flips. ``gs{i}`` has the state after i iterations."""
    lab = "['entailment', 'contradiction', 'neutral']"
    scaled = "(p.score[{i}] / CAST(1000000 AS DOUBLE))"
    top = "list_max(list_transform(p.score, lambda x: x / CAST(1000000 AS DOUBLE)))"
    total = "(" + " + ".join(f"exp({scaled.format(i=i)} - {top})" for i in (1, 2, 3)) + ")"
    push = ", ".join(f"CAST(sum(CASE WHEN p.split = 'train' THEN CASE WHEN p.gold = {lab}[{i}] THEN 1000000 ELSE 0 END "
                     f"- CAST(round(exp({scaled.format(i=i)} - {top}) / {total} * 1000000) AS BIGINT) ELSE 0 END) AS DOUBLE) AS g{i}"
                     for i in (1, 2, 3))
    count = (f"count(*) FILTER (p.correct AND p.split = 'train') AS n_correct, "
             f"count(*) FILTER (p.correct AND p.split = 'dev') / (count(*) FILTER (p.split = 'dev') + 1e-13) AS dev, {push}")

    def score(p: str, variants: str) -> list[tuple[str, str]]:
        return oe.scorer(p, "gboth", variants, train="gtrain", key=("ex_id", "split"))

    out = [("gheld", HELD), ("gtrain", "SELECT * FROM v1 WHERE ex_id NOT IN (SELECT ex_id FROM gheld)"),
           ("gboth", "SELECT *, CASE WHEN ex_id IN (SELECT ex_id FROM gheld) THEN 'dev' ELSE 'train' END AS split FROM v1"),
           ("gi_v", "SELECT seed, 'cand:' || seed || ':0' AS variant_id, tokens FROM v5t"), *score("gi", "gi_v"),
           ("gs0", f"""SELECT v.seed, any_value(v.tokens) AS tokens, CAST(NULL AS DOUBLE) AS best, -1 AS iter,
                  CAST(NULL AS INTEGER) AS slot, CAST(NULL AS VARCHAR) AS token, CAST(NULL AS INTEGER) AS cur_correct,
                  CAST(NULL AS INTEGER) AS new_correct, round(any_value(c.dev), 6) AS dev_acc, false AS new_best,
                  any_value(c.g1) AS g1, any_value(c.g2) AS g2, any_value(c.g3) AS g3
                FROM gi_v v JOIN (SELECT variant_id, {count} FROM gi_pr p GROUP BY variant_id) c
                  ON c.variant_id = v.variant_id GROUP BY v.seed""")]
    for it in range(SQL_ITERS):
        s, q = f"gs{it}", f"g{it}x"
        slot = f"CAST({sql_hnum('s.seed', chr(39) + str(it) + chr(39))} % 10 AS INTEGER)"
        w = " + ".join(f"CAST(coalesce(w.w[{i}], p.w0[{i}]) AS DOUBLE) * s.g{i}" for i in (1, 2, 3))
        out += [
            (f"{q}_c", f"""SELECT * FROM (SELECT seed, token, CAST(row_number() OVER (PARTITION BY seed
                      ORDER BY gain DESC, token) AS INTEGER) AS cand_rank
                    FROM (SELECT s.seed, a.token, {w} AS gain FROM {s} s CROSS JOIN allowed a
                          JOIN gi_pri p ON p.seed = s.seed
                          LEFT JOIN gi_wt w ON w.seed = s.seed AND w.token = a.token) g) r WHERE cand_rank <= {N_CAND}"""),
            (f"{q}_v", f"""SELECT seed, 'cand:' || seed || ':0' AS variant_id, 0 AS cand_rank,
                      CAST(NULL AS VARCHAR) AS token, tokens FROM {s}
                    UNION ALL SELECT s.seed, 'cand:' || s.seed || ':' || c.cand_rank, c.cand_rank, c.token,
                      list_transform(s.tokens, lambda x, i: CASE WHEN i - 1 = {slot} THEN c.token ELSE x END)
                    FROM {s} s JOIN {q}_c c ON c.seed = s.seed"""),
            *score(q, f"{q}_v"),
            (f"{q}_n", f"""SELECT v.seed, v.cand_rank, v.token, any_value(v.tokens) AS tokens, {count}
                    FROM {q}_pr p JOIN {q}_v v ON v.variant_id = p.variant_id GROUP BY v.seed, v.cand_rank, v.token"""),
            (f"gs{it + 1}", f"""SELECT s.seed, CASE WHEN ok THEN b.tokens ELSE s.tokens END AS tokens,
                      CASE WHEN ok AND better THEN b.dev ELSE s.best END AS best, {it} AS iter, {slot} AS slot,
                      CASE WHEN ok THEN b.token END AS token,
                      CAST(CASE WHEN ok THEN cur END AS INTEGER) AS cur_correct,
                      CAST(CASE WHEN ok THEN b.n_correct END AS INTEGER) AS new_correct,
                      CASE WHEN ok THEN round(b.dev, 6) END AS dev_acc, (ok AND better) AS new_best,
                      CASE WHEN ok THEN b.g1 ELSE s.g1 END AS g1, CASE WHEN ok THEN b.g2 ELSE s.g2 END AS g2,
                      CASE WHEN ok THEN b.g3 ELSE s.g3 END AS g3
                    FROM (SELECT s.*, b.n_correct > k.n_correct AS ok, k.n_correct AS cur,
                                 NOT list_contains(b.tokens, '<mask>') AND (s.best IS NULL OR b.dev > s.best) AS better,
                                 b AS b
                          FROM {s} s JOIN {q}_n k ON k.seed = s.seed AND k.cand_rank = 0
                          JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed
                                  ORDER BY n_correct DESC, cand_rank) AS r FROM {q}_n WHERE cand_rank > 0) z
                                WHERE r = 1) b ON b.seed = s.seed) s"""),
        ]
    return out


_LOG = "SELECT seed, CAST(iter AS INTEGER) AS iter, slot, token, cur_correct, new_correct, dev_acc, new_best FROM "


SEARCH_SQL = with_views(
    ["v1", "v4", "v5l", "v5t", "seeds", "labels_c"],
    " UNION ALL ".join(f"{_LOG} gs{i}" for i in range(SQL_ITERS + 1)), [_ALLOWED, *_search_sql()])


@register("greedy_trigger_search")
def greedy_trigger_search(spark, sf):
    """The whole search, ``ITERS`` greedy iterations per seed with gradient-ranked candidates.
    No SQL; the first iterations are tested against ``SEARCH_SQL``."""
    return search_steps(spark, sf, ITERS)


def search_steps(spark, sf, iters):
    v1, wc, lw, trig = search_inputs(spark, sf)
    train, dev = pr.holdout(v1, 50, seed=0)
    return se.greedy_search(train, dev, trig, se.allowed_tokens(wc, lw, SPECIALS), iters=iters, k=N_CAND)


_PROBE = [SEQ, ("pool", """SELECT ex, list(m ORDER BY d) AS v FROM (
        SELECT ex, d, avg(CAST(x AS DOUBLE)) AS m FROM (
          SELECT ex, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM seq WHERE pos > 0) t
        GROUP BY ex, d) u GROUP BY ex"""),
    ("prb", f"""SELECT p.ex, list_concat(p.v, [CAST(1 AS DOUBLE)]) AS x, s.label AS y,
              CASE WHEN {sql_hnum("'0'", 'p.ex')} % 5 = 0 THEN 'dev' ELSE 'train' END AS split
            FROM pool p JOIN seq s ON s.ex = p.ex AND s.pos = 0"""),
    ("prt", "SELECT x, y FROM prb WHERE split = 'train'"), *_softmax_fit("g8", "prt")]


PROBE_SQL = with_views(["v8"], f"""
    SELECT split, count(*) AS n, CAST(sum(CAST(list_position(lg, list_max(lg)) - 1 = y AS INTEGER)) AS BIGINT) AS n_correct
    FROM (SELECT split, y, list_transform(w, lambda c: list_sum(list_transform(range({DIMS + 1}),
                   lambda i: c[i + 1] * x[i + 1]))) AS lg FROM prb, g8_w{FIT_STEPS}) t GROUP BY split""", _PROBE)


@register("linear_probe")
def linear_probe(spark, sf):
    """Mean-pooled sequences -> logistic regression trained in mini-batches, the weights of
    the best of ``EPOCHS`` epochs on the dev rows; train/dev correct counts. No SQL; the
    first full-batch steps are tested against ``PROBE_SQL``."""
    rows = se.pooled_rows(se.sequences(fx.vectors(spark, sf)), DIMS)
    return se.train_probe(rows, CLASSES, DIMS, EPOCHS)


def linear_probe_full(spark, sf):
    """G8 by full-batch steps, the operator's own number of them; no SQL."""
    return probe_steps(spark, sf)


def probe_steps(spark, sf, **steps):
    seq = se.sequences(fx.vectors(spark, sf))
    labels = seq.filter(F.col("pos") == 0).select("ex", "label")
    return se.linear_probe(se.mean_pool(seq), labels, CLASSES, DIMS, rate=RATE, **steps)


# finished fits, without SQL (registered by the entry module)
FULL_FITS = {f.__name__: f for f in (label_projection_full, linear_probe_full)}


@register("mean_pool", with_views(["v8"], """
    SELECT ex, CAST(d AS INTEGER) AS d, round(avg(CAST(x AS DOUBLE)), 6) AS value
    FROM (SELECT ex, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM seq WHERE pos > 0) t
    GROUP BY ex, d""", [SEQ]))
def mean_pool(spark, sf):
    """Mean of each sequence's vectors except position 0."""
    return se.mean_pool(se.sequences(fx.vectors(spark, sf))).withColumn("value", F.round("value", 6))
