"""Prompt search (G): label-token ranking, gradient-guided candidates, greedy trigger search,
linear probing and pooling, as Spark jobs over vector tables.

Vector tables are ``(id, embedding array<float>)``. Small per-class or per-slot vectors
(bounded by the number of classes / slots, not by data) are joined by an explicit key and
broadcast; the vector table itself streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustq.functions.bind import bind
from robustq.functions.hashing import hkey, hnum


def dot(a, b) -> Column:
    """Dot product of two numeric arrays, summed in index order."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def class_centroids(vectors: DataFrame, label: str = "label", emb: str = "embedding") -> DataFrame:
    """(cls, centroid array<double>): per-class mean vector (one row per class)."""
    e = vectors.select(F.col(label).alias("cls"), F.posexplode(emb).alias("d", "x"))
    m = e.groupBy("cls", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))),
                                            lambda s: s["m"]).alias("centroid"))


# -- G1 / G8 ------------------------------------------------------------------------
def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def softmax(logits: Column) -> Column:
    """Softmax of an array (shifted by its maximum)."""
    def shifted(lg: Column) -> Column:
        return bind(F.array_max(lg), lambda mx: F.transform(lg, lambda x: F.exp(x - mx)))

    def shares(e: Column) -> Column:
        return bind(F.aggregate(e, F.lit(0.0), lambda a, y: a + y),
                    lambda total: F.transform(e, lambda x: x / total))
    return bind(logits, lambda lg: bind(shifted(lg), shares))


def fit_softmax(vectors: DataFrame, classes: Sequence[int], dims: int, steps: int, rate: float,
                label: str = "label", emb: str = "embedding") -> list[list[float]]:
    """Multinomial logistic regression by ``steps`` full-batch gradient steps from zero:
    classes x (dims + 1) numbers, the intercept last. The rows are written once; each step is
    one pass over them in Arrow batches, a partial gradient per task, and what reaches the driver
    is the gradient, whose size is that of the model. Rows of other labels count as no class."""
    import numpy as np
    import pyarrow as pa

    from robustq.functions.materialize import materialize
    from robustq.operators.training import softmax_rows
    k, width = len(classes), dims + 1
    x = F.concat(F.transform(F.col(emb), lambda v: v.cast("double")), F.array(F.lit(1.0)))
    data = materialize(vectors.select(x.alias("x"), F.col(label).alias("y")))
    n = data.count()
    weights = np.zeros((k, width))

    def gradient(w):
        def run(batches):
            total = np.zeros((k, width))
            for rb in batches:
                rows = np.asarray(rb.column(0).flatten()).reshape(rb.num_rows, -1)
                y = np.array(rb.column(1).to_pylist(), dtype=object)
                p = softmax_rows(rows @ w.T)
                for i, c in enumerate(classes):
                    p[:, i] -= y == c
                total += p.T @ rows
            yield pa.RecordBatch.from_arrays([pa.array(range(k * width), pa.int32()), pa.array(total.ravel())],
                                             names=["at", "g"])
        got = data.mapInArrow(run, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
        out = np.zeros(k * width)
        out[[r["at"] for r in got]] = [r["g"] for r in got]
        return out.reshape(k, width)

    for _ in range(steps if n else 0):
        weights = weights - rate * gradient(weights) / n
    return weights.tolist()


def fit_projection(vectors: DataFrame, classes: Sequence[int], dims: int, steps: int = 100,
                   rate: float = 1.0, label: str = "label", emb: str = "embedding") -> DataFrame:
    """G1: the fitted projection from vectors to classes as (cls, weights array<double>,
    intercept double) rows."""
    w = fit_softmax(vectors, classes, dims, steps, rate, label, emb)
    rows = [(int(c), r[:-1], r[-1]) for c, r in zip(classes, w)]
    return vectors.sparkSession.createDataFrame(rows, "cls int, weights array<double>, intercept double")


def train_projection(vectors: DataFrame, classes: Sequence, dims: int, epochs: int, batch: int = 32,
                     rate: float = 1e-2, label: str = "label", emb: str = "embedding", key: str = "vec_id",
                     state_dir: str | None = None) -> DataFrame:
    """G1 in mini-batches (:func:`robustq.operators.training.train_softmax`): the projection after
    ``epochs`` epochs as (cls, weights array<double>, intercept double) rows."""
    from robustq.operators.training import train_softmax
    t = train_softmax(vectors, classes, dims, epochs, batch, rate, key=key, x=emb, y=label, state_dir=state_dir)
    rows = [(int(c), w[:-1], w[-1]) for c, w in zip(classes, t.weights.tolist())]
    return vectors.sparkSession.createDataFrame(rows, "cls int, weights array<double>, intercept double")


# -- G2 -----------------------------------------------------------------------------
def top_label_tokens(weights: DataFrame, vectors: DataFrame, k: int = 50, w_col: str = "centroid",
                     id_col: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """(cls, rank, vec_id, score): for every token vector, softmax over classes of W_c . e,
    then the k best tokens per class (ties -> smaller id). The class vectors (classes x dims
    numbers, whatever the data) become literals, so the softmax is row-local; the per-class
    top-k is a partial top-k per task before the only shuffle."""
    rows = sorted((r["cls"], list(r[w_col])) for r in weights.select("cls", w_col).collect())
    ids = F.array(*[F.lit(c) for c, _ in rows])
    lits = F.array(*[_array(w) for _, w in rows])
    p = softmax(F.transform(lits, lambda w: dot(w, F.col(emb))))
    s = vectors.select(id_col, F.posexplode(p).alias("i", "score")) \
        .select(id_col, F.get(ids, F.col("i")).alias("cls"), "score")
    r = Window.partitionBy("cls").orderBy(F.col("score").desc(), F.col(id_col))
    return (s.withColumn("rank", F.row_number().over(r)).filter(F.col("rank") <= k)
            .select("cls", "rank", id_col, "score"))


# -- G3 -----------------------------------------------------------------------------
def sequences(vectors: DataFrame, width: int = 10, id_col: str = "vec_id") -> DataFrame:
    """Read a vector table as token sequences: ex = id div width, pos = id mod width."""
    return vectors.withColumn("ex", F.floor(F.col(id_col) / width).cast("bigint")) \
        .withColumn("pos", (F.col(id_col) % width).cast("int"))


def mean_slot(seq: DataFrame, bsz: int, steps: int | None = None, emb: str = "embedding",
              seed: int = 0) -> DataFrame:
    """(slot, d, g): per-slot vector sum over the batches of ``bsz`` examples, divided by the
    number of batches. All examples by default; with ``steps`` only the first batches of the
    hash-shuffled examples, divided by ``steps`` even when fewer exist."""
    if steps is None:
        n = seq.agg(F.countDistinct("ex").alias("n")).first()["n"]
        parts = max(1, -(-n // bsz))
    else:
        parts = steps
        drawn = seq.select("ex").distinct().orderBy(hkey(F.lit(str(seed)), "ex"), "ex").limit(bsz * steps)
        seq = seq.join(drawn, "ex", "left_semi")
    e = seq.select(F.col("pos").alias("slot"), F.posexplode(emb).alias("d", "x"))
    return e.groupBy("slot", "d").agg((F.sum(F.col("x").cast("double")) / parts).alias("g"))


# -- G4 -----------------------------------------------------------------------------
def hotflip(grad: DataFrame, vectors: DataFrame, k: int, increase_loss: bool = False,
            exclude: DataFrame | None = None, id_col: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """(rank, vec_id, score): top-k of -(E . g) (or +(E . g) when increasing the loss) over
    token vectors not in ``exclude``. ``grad`` is (d, g) for one slot (one row per dimension):
    it becomes a literal array, the products are row-local, the top-k is the only exchange."""
    g = [r["g"] for r in grad.select("d", "g").orderBy("d").collect()]
    v = vectors
    if exclude is not None:
        v = v.join(exclude.select(id_col), id_col, "left_anti")
    sign = 1.0 if increase_loss else -1.0
    sc = v.select(id_col, (F.lit(sign) * dot(_array(g), F.col(emb))).alias("score"))
    top = sc.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)  # the top-k report
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(id_col))))


# -- G5 -----------------------------------------------------------------------------
def allowed_tokens(vocab: DataFrame, labelmap: DataFrame, specials: Sequence[str],
                   token: str = "token") -> DataFrame:
    """Candidate tokens: not a label token; special and capitalised tokens removed unless
    the token is a single character."""
    first = F.substring(F.col(token), 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    special = F.col(token).isin(list(specials))
    single = F.length(token) == 1
    v = vocab.filter(single | (~special & ~capital))
    return v.join(labelmap.select(token).distinct(), token, "left_anti")


# -- G6 -----------------------------------------------------------------------------
def slot_for(seed_col: str, iteration: int, n: int) -> Column:
    """The slot flipped at an iteration: md5(seed:iteration) mod n."""
    return (hnum(seed_col, F.lit(str(iteration))) % n).cast("int")


def candidate_variants(triggers: DataFrame, candidates: DataFrame, iteration: int = 0,
                       n_tokens: int = 10) -> DataFrame:
    """Current trigger (cand_rank 0) plus one variant per candidate token (ranked 1..k) at
    the iteration's slot, per seed; a candidate the trigger already holds is tried like any
    other. Both inputs are bounded (seeds x k rows)."""
    t = triggers.withColumn("slot", slot_for("seed", iteration, n_tokens))
    cur = t.select("seed", "slot", F.lit(0).alias("cand_rank"), F.lit(None).cast("string").alias("token"), "tokens")
    c = t.join(candidates, "seed")
    c = c.select("seed", "slot", "cand_rank", "token",
                 F.transform("tokens", lambda x, i: F.when(i == F.col("slot"), F.col("token")).otherwise(x)).alias("tokens"))
    return cur.unionByName(c).withColumn(
        "variant_id", F.concat_ws(":", F.lit("cand"), F.col("seed").cast("string"), F.col("cand_rank").cast("string")))


def score_candidates(counts: DataFrame) -> DataFrame:
    """Given (seed, cand_rank, token, n_correct): compare each candidate with the current
    trigger (cand_rank 0); accept the best only if strictly better, first rank wins ties."""
    cur = counts.filter(F.col("cand_rank") == 0).select("seed", F.col("n_correct").alias("cur_correct"))
    c = counts.filter(F.col("cand_rank") > 0).join(cur, "seed")
    w = Window.partitionBy("seed").orderBy(F.col("n_correct").desc(), F.col("cand_rank"))
    c = c.withColumn("_r", F.row_number().over(w))  # candidates of one seed: bounded
    return c.withColumn("accepted", (F.col("_r") == 1) & (F.col("n_correct") > F.col("cur_correct"))).drop("_r")


# -- G9 -----------------------------------------------------------------------------
def mean_pool(seq: DataFrame, emb: str = "embedding", skip_first: bool = True) -> DataFrame:
    """(ex, d, value): mean token vector per example, position 0 excluded (pads are not
    masked, as in the reference)."""
    s = seq.filter(F.col("pos") > 0) if skip_first else seq
    e = s.select("ex", F.posexplode(emb).alias("d", "x"))
    return e.groupBy("ex", "d").agg(F.avg(F.col("x").cast("double")).alias("value"))


# -- G8 -----------------------------------------------------------------------------
def pooled_rows(seq: DataFrame, dims: int, emb: str = "embedding") -> DataFrame:
    """(ex, v, label): the mean vector of each sequence without its first token, and the label of
    position 0, by one aggregation (no explode)."""
    rest = F.col("pos") > 0
    means = [F.avg(F.when(rest, F.get(F.col(emb), j).cast("double"))).alias(f"m{j}") for j in range(dims)]
    d = seq.groupBy("ex").agg(F.max(F.when(F.col("pos") == 0, F.col("label"))).alias("label"), *means)
    return d.where(F.col("label").isNotNull() & F.col("m0").isNotNull()) \
        .select("ex", F.array(*[F.col(f"m{j}") for j in range(dims)]).alias("v"), "label")


def _probe_split(rows: DataFrame, dev_fraction_mod: int, seed: int) -> DataFrame:
    from robustq.functions.materialize import materialize
    split = F.when(hnum(F.lit(str(seed)), "ex") % dev_fraction_mod == 0, "dev").otherwise("train")
    return materialize(rows.withColumn("split", split))


def _probe_counts(d: DataFrame, classes: Sequence[int], weights) -> DataFrame:
    from robustq.operators.training import predicted_class
    pred = F.get(F.array(*[F.lit(int(c)) for c in classes]), predicted_class(weights, "v"))
    return (d.withColumn("ok", (pred == F.col("label")).cast("int"))
            .groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("n_correct")))


def linear_probe(pooled: DataFrame, labels: DataFrame, classes: Sequence[int], dims: int,
                 dev_fraction_mod: int = 5, seed: int = 0, steps: int = 100, rate: float = 1.0) -> DataFrame:
    """Frozen mean-pooled vectors -> multinomial logistic regression (:func:`fit_softmax`);
    (split, n, n_correct) on train and dev (dev = hash bucket 0 of ``dev_fraction_mod``)."""
    vec = pooled.groupBy("ex").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "value"))),
                                               lambda s: s["value"]).alias("v"))  # one vector per example
    d = _probe_split(vec.join(labels, "ex").select("ex", "v", "label"), dev_fraction_mod, seed)
    w = fit_softmax(d.filter(F.col("split") == "train"), classes, dims, steps, rate, "label", "v")
    return _probe_counts(d, classes, w)


def train_probe(rows: DataFrame, classes: Sequence[int], dims: int, epochs: int, batch: int = 32,
                rate: float = 1e-2, decay: float = 1e-6, dev_fraction_mod: int = 5, seed: int = 0,
                state_dir: str | None = None) -> DataFrame:
    """G8 in mini-batches with weight decay: the weights of the epoch with the strictly best dev
    accuracy; (split, n, n_correct) as :func:`linear_probe`."""
    from robustq.operators.training import train_softmax
    d = _probe_split(rows, dev_fraction_mod, seed)
    train, dev = (d.filter(F.col("split") == s) for s in ("train", "dev"))
    t = train_softmax(train, classes, dims, epochs, batch, rate, decay, dev, key="ex", x="v", y="label",
                      state_dir=state_dir)
    return _probe_counts(d, classes, t.best)


# -- G7 -----------------------------------------------------------------------------
def search_space(fitted, allowed: DataFrame, seeds: Sequence[int], k: int) -> DataFrame:
    """(token, w_<seed>...) of every allowed token that can be among the k best of any seed:
    the allowed tokens with learnt weights, and the k first of the others, which all weigh the
    same and are ranked by name."""
    known = fitted.weights.join(allowed.select("token"), "token", "left_semi")
    rest = (allowed.select("token").join(fitted.weights.select("token"), "token", "left_anti")
            .orderBy("token").limit(k))
    return known.unionByName(rest, allowMissingColumns=True).select("token", *[f"w_{s}" for s in seeds])


def gradient_candidates(space: DataFrame, push: dict[int, list], priors: dict[int, list[int]],
                        k: int) -> DataFrame:
    """Per seed the k tokens with the largest first-order gain (seed, cand_rank, token, w).

    The additive score of class y grows with w(token, y) at the flipped slot, so the gain is the
    sum over classes of ``push`` (minus the loss gradient of the class score at the current
    trigger, :func:`loss_push`) times the token's weight; unseen tokens weigh the prior. Ties go
    to the smaller token."""
    rows = []
    for s, g in sorted(push.items()):
        w = F.coalesce(F.col(f"w_{s}"), F.array(*[F.lit(x).cast("bigint") for x in priors[s]]))
        term = lambda i: F.get(w, i).cast("double") * F.lit(float(g[i]))
        gain = term(0)
        for i in range(1, len(g)):
            gain = gain + term(i)
        rows.append(F.struct(F.lit(s).alias("seed"), gain.alias("gain"), w.alias("w")))
    d = space.select("token", F.explode(F.array(*rows)).alias("r")).select("token", "r.*")
    w = Window.partitionBy("seed").orderBy(F.col("gain").desc(), F.col("token"))
    return (d.withColumn("cand_rank", F.row_number().over(w)).filter(F.col("cand_rank") <= k)
            .select("seed", "cand_rank", "token", "w"))


def loss_push(score: Column, gold: Column, n_labels: int, scale: float) -> Column:
    """Minus the cross-entropy gradient of one example's class scores, 1[gold = y] - softmax(score
    / scale)_y, in whole millionths, so that sums do not depend on their order."""
    p = softmax(F.transform(score, lambda x: x / F.lit(scale)))
    return F.transform(p, lambda x, i: F.when(gold == i, F.lit(1_000_000)).otherwise(F.lit(0)).cast("bigint")
                       - F.round(x * 1_000_000).cast("bigint"))


def flip_slot(seed: int, iteration: int, n: int) -> int:
    """:func:`slot_for` on the driver."""
    import hashlib
    return int(hashlib.md5(f"{seed}:{iteration}".encode()).hexdigest()[:15], 16) % n


def greedy_search(train: DataFrame, dev: DataFrame, triggers: DataFrame, allowed: DataFrame,
                  iters: int, scorer=None, n_tokens: int = 10, k: int = 10,
                  mask: str = "<mask>") -> DataFrame:
    """Greedy trigger search; the loop is on the driver, every step is Spark jobs.

    Per iteration and seed: rank the allowed vocabulary by the loss gradient at one hash-chosen
    slot (:func:`loss_push`, :func:`gradient_candidates`), score the k best against the current
    trigger on the training rows, accept the best only if strictly better; keep a trigger as best
    only if its dev accuracy strictly improves. The first accepted flip always becomes best (the
    initial dev metric is logged, not compared), and a trigger that still holds ``mask`` never
    does, as in the reference.

    Candidates depend on the trigger and the slot alone, so a slot that was tried since the last
    accepted flip cannot succeed: its iteration is logged without a job, and once all slots were
    tried the rest of the search is known. The result is that of all ``iters`` iterations.

    Dev rows are scored in the same job as the training rows: dev accuracy depends only on the
    trigger, so the log is that of a separate dev evaluation after each accepted flip. What
    reaches the driver per step is one row per (seed, candidate); the scores of the few variants
    are sums of token weights that it already has. Example scores of both splits are written
    once, so lineage stays short and a step is one pass over them."""
    from robustq.functions.materialize import materialize
    from robustq.operators.scoring import SCALE, AdditiveScorer, class_id, grid_join, predict_from_scores, summed
    scorer = scorer or AdditiveScorer()
    spark = train.sparkSession
    fitted = scorer.fit(train)
    n_labels = len(scorer.labels)
    both = (train.withColumn("split", F.lit("train"))
            .unionByName(dev.withColumn("split", F.lit("dev"))))
    scores = materialize(scorer.example_scores(both, fitted, key=("ex_id", "split")))
    space = materialize(search_space(fitted, allowed, scorer.seeds, k))
    current = {r["seed"]: list(r["tokens"]) for r in triggers.select("seed", "tokens").collect()}
    is_dev = F.col("split") == "dev"
    right = F.col("correct").cast("int")
    counts = [F.sum(F.when(~is_dev, right).otherwise(0)).alias("n_correct"),
              (F.sum(F.when(is_dev, right).otherwise(0)) / (F.sum(is_dev.cast("int")) + F.lit(1e-13))).alias("dev_acc")]

    # weights of the tokens that triggers hold: those at the start, then the accepted candidates
    held = sorted({t for ts in current.values() for t in ts if t})
    known = {(s, r["token"]): r[f"w_{s}"] for r in fitted.weights.filter(F.col("token").isin(held)).collect()
             for s in current}

    def variant(seed: int, tokens: list[str]) -> list[int]:
        """Class scores of a trigger (:meth:`AdditiveScorer.variant_scores`)."""
        out, n = [0] * n_labels, len(tokens)
        for i, t in enumerate(tokens):
            for y, w in enumerate((known.get((seed, t)) or fitted.priors[seed]) if t else ()):
                out[y] += (n - i) * w
        return out

    def grid(slots: dict[int, int], cands: list[tuple]) -> DataFrame:
        """The current trigger of each seed (rank 0) and its candidates, over all examples."""
        rows = [(s, slot, 0, None, variant(s, current[s])) for s, slot in slots.items()]
        for s, rank, token, w in cands:
            known[s, token] = w
            rows.append((s, slots[s], rank, token, variant(
                s, [token if i == slots[s] else t for i, t in enumerate(current[s])])))
        var = spark.createDataFrame(rows, "seed int, slot int, cand_rank int, token string, t array<bigint>")
        g = grid_join(scores, var, ["seed"], len(rows), max(len(rows), scorer.variant_rows))
        return g.withColumn("score", summed("s", "t", n_labels)).drop("s", "t")

    def assess(seeds: list[int]) -> dict:
        """Counts and gradient of the current triggers, one job."""
        g = grid({s: 0 for s in seeds}, []).withColumn("push", loss_push(
            F.col("score"), class_id(F.col("gold"), scorer.labels), n_labels, float(SCALE)))
        push = [F.sum(F.when(~is_dev, F.get("push", i)).otherwise(0)).alias(f"g{i}") for i in range(n_labels)]
        got = predict_from_scores(g).groupBy("seed").agg(*counts, *push).collect()
        return {r["seed"]: r for r in got}

    def ranked(states: dict) -> dict[int, list[tuple]]:
        push = {s: [r[f"g{i}"] for i in range(n_labels)] for s, r in states.items()}
        out: dict[int, list[tuple]] = {s: [] for s in push}
        for r in gradient_candidates(space, push, fitted.priors, k).collect() if push else []:
            out[r["seed"]].append((r["seed"], r["cand_rank"], r["token"], list(r["w"])))
        return out

    def step(slots: dict[int, int]) -> dict[int, list]:
        """One job: the counts of the current trigger (rank 0) and of every candidate."""
        p = predict_from_scores(grid(slots, [c for s in slots for c in cands[s]]))
        out: dict[int, list] = {}
        for r in p.groupBy("seed", "slot", "cand_rank", "token").agg(*counts).collect():
            out.setdefault(r["seed"], []).append(r)
        return {s: sorted(rs, key=lambda r: r["cand_rank"]) for s, rs in out.items()}

    first = assess(sorted(current))
    log = [(s, -1, None, None, None, None, round(r["dev_acc"], 6), False) for s, r in sorted(first.items())]
    cands = ranked(first)
    best: dict[int, float | None] = {s: None for s in first}
    tried: dict[int, set[int]] = {s: set() for s in first}
    for it in range(iters):
        slots = {s: flip_slot(s, it, n_tokens) for s in sorted(first)}
        todo = {s: slot for s, slot in slots.items() if slot not in tried[s]}
        got = step(todo) if todo else {}
        changed = []
        for s, slot in slots.items():
            tried[s].add(slot)
            cur, *others = got.get(s) or [None]
            top = max(others, key=lambda r: (r["n_correct"], -r["cand_rank"]), default=None)
            if top is None or top["n_correct"] <= cur["n_correct"]:
                log.append((s, it, slot, None, None, None, None, False))
                continue
            current[s][slot] = top["token"]
            changed.append(s)
            tried[s] = set()
            improved = mask not in current[s] and (best[s] is None or top["dev_acc"] > best[s])
            if improved:
                best[s] = top["dev_acc"]
            log.append((s, it, slot, top["token"], int(cur["n_correct"]), int(top["n_correct"]),
                        round(top["dev_acc"], 6), improved))
        if changed:
            cands.update(ranked(assess(changed)))
    return spark.createDataFrame(log, "seed int, iter int, slot int, token string, cur_correct int, "
                                      "new_correct int, dev_acc double, new_best boolean")
