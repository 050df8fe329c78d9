"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (consecutive words). Every passage of every text is encoded:
shape features of its words and characters and a signed random projection of its bag of words,
all numpy over a chunk of texts. A learnt layer embeds the passages, gated attention weights
them, and the weighted embedding is scored:

    h = tanh(x We + be);  a = softmax((tanh(h V) * sigmoid(h U)) w);  p = sigmoid(sum(a h) c + c0)

Labels are of documents only; the weights of We, V, U, w and c are learnt from them by full
gradient steps (Adam) over a bounded, balanced sample of labelled documents
(``SAMPLE_PER_CLASS``, texts up to ``SAMPLE_CHARS`` characters). The sample's passages are
encoded by Spark tasks; scoring covers whole texts.

Defined cases: null and wordless texts get the sample's share of label 1 as score; without
labelled documents of both classes every score is that share (0.5 without any); conflicting
labels of one id are averaged, ties count as 1; repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustq.llm.common import broadcast_if_bounded, map_texts, saved
from robustq.llm.words import Words, byte_table

PASSAGE_WORDS = 64        # parameter
PROJECTIONS = 16          # parameter: signs per word
SAMPLE_PER_CLASS = 600    # parameter: labelled documents of each class in the fit
SAMPLE_CHARS = 20_000     # parameter: longest text in the fit
HIDDEN, ATTENTION = 16, 8
STEPS, RATE, DECAY = 200, 0.03, 1e-3

# words are runs of anything but ASCII white space, not folded
_TABLE = byte_table(bytes(b for b in range(256) if b != 32 and not 9 <= b <= 13), fold=False)


def _byte_set(chars: str | range) -> np.ndarray:
    t = np.zeros(256, np.float32)
    for c in chars:
        t[c if isinstance(c, int) else ord(c)] = 1
    return t


_SETS = [_byte_set(range(65, 91)), _byte_set(range(48, 58)), _byte_set(range(128, 256)),
         _byte_set("#*$%&|<>"), _byte_set(".,;:!?"), _byte_set("@_/\\=+~^(){}[]\"'`-")]
N_FEATURES = len(_SETS) + 4 + PROJECTIONS


def encode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages per text) of a chunk of texts."""
    w = Words(col, _TABLE)
    n = len(w.starts)
    per_text = -(-w.counts // PASSAGE_WORDS)
    if not n:
        return np.zeros((0, N_FEATURES), np.float32), per_text
    # first word of every passage: every PASSAGE_WORDS-th word of a text
    inside = np.arange(int(per_text.sum())) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = np.repeat(w.first[:-1], per_text) + inside * PASSAGE_WORDS
    size = np.diff(np.append(first, n)).astype(np.float32)
    length = (w.ends - w.starts).astype(np.float32)
    chars = np.add.reduceat(length, first)
    out = np.empty((len(first), N_FEATURES), np.float32)
    # a passage's bytes go on to the next one's first byte; the gaps count in no set
    at = w.starts[first]
    for j, s in enumerate(_SETS):
        out[:, j] = np.add.reduceat(s[w.data], at) / chars
    h = w.hashes()
    again = np.zeros(n, np.float32)
    again[1:] = h[1:] == h[:-1]
    again[first] = 0
    j = len(_SETS)
    out[:, j] = chars / size / 8
    out[:, j + 1] = np.add.reduceat(again, first) / size
    seen = np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), first)
    out[:, j + 2] = np.bitwise_count(seen) / np.minimum(size, 64)
    out[:, j + 3] = np.log1p(size) / 4
    norm = np.sqrt(size)
    for i in range(PROJECTIONS):
        sign = ((h >> np.uint64(8 + i)) & np.uint64(1)).astype(np.float32) * 2 - 1
        out[:, j + 4 + i] = np.add.reduceat(sign, first) / norm
    return out, per_text


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    share: float                        # share of label 1, the score of empty texts
    weights: dict[str, np.ndarray] | None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict:
    """Bags are the passages from each ``first`` on; all are non-empty."""
    h = np.tanh(x @ p["We"] + p["be"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    e = np.exp(s - np.maximum.reduceat(s, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag,
            "p": _sigmoid(z @ p["c"] + p["c0"][0])}


def gradient(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean log loss with weight decay, and its gradient."""
    f = forward(p, x, first)
    q = np.clip(f["p"], 1e-9, 1 - 1e-9)
    loss = float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    loss += DECAY / 2 * sum(float((v * v).sum()) for v in p.values())
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * p["c"][None, :]
    dzi = dz[f["bag"]]
    dh = f["a"][:, None] * dzi
    da = (f["h"] * dzi).sum(axis=1)
    ds = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["bag"]])
    gate = ds[:, None] * p["w"][None, :]
    dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
    dh = dh + dt @ p["V"].T + dg @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    out = {"We": x.T @ dx, "be": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
           "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "c0": np.array([d.sum()])}
    return loss, {k: v + DECAY * p[k] for k, v in out.items()}


def start_weights(features: int, seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    def draw(a, b):
        return r.normal(0, 1 / np.sqrt(a), (a, b))
    return {"We": draw(features, HIDDEN), "be": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION),
            "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0],
            "c": draw(HIDDEN, 1)[:, 0], "c0": np.zeros(1)}


def learn(x: np.ndarray, per_bag: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Model:
    """Fit on bags of passages (``per_bag`` passages each, in order) with labels 0/1."""
    share = float(y.mean()) if len(y) else 0.5
    mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
    scale = x.std(axis=0) + 1e-3 if len(x) else np.ones(N_FEATURES)
    full = per_bag > 0
    y, per_bag = y[full], per_bag[full]
    if len(np.unique(y)) < 2:
        return Model(mean, scale, share, None)
    x = (x - mean) / scale
    first = np.cumsum(per_bag) - per_bag
    p = start_weights(x.shape[1])
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        _, g = gradient(p, x, first, y)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (
                np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, share, p)


def predict(model: Model, col: pa.Array) -> np.ndarray:
    """Score of every text of a chunk."""
    x, per_text = encode(col)
    out = np.full(len(per_text), model.share)
    full = np.flatnonzero(per_text)
    if model.weights is not None and len(full):
        first = np.cumsum(per_text[full]) - per_text[full]
        out[full] = forward(model.weights, (x - model.mean) / model.scale, first)["p"]
    return out


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id",
        text: str = "text", label: str = "quality") -> Model:
    """Learn from the labelled documents where ``train`` (over the label rows) holds: of each
    class the ``SAMPLE_PER_CLASS`` first by a hash of the id."""
    rated = (labels.where(train & F.col(label).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(id_col).agg((F.avg(label) >= 0.5).cast("int").alias("__y")))
    texts = docs.select(F.col(id_col), F.col(text).alias("__x")) \
        .where(F.length("__x").between(1, SAMPLE_CHARS))
    share = rated.agg(F.avg("__y").alias("s")).first()["s"]
    w = Window.partitionBy("__y").orderBy("__h", id_col)
    # twice the size, since some of the chosen ids may have no text that fits; each class is a
    # top-n of its own (what a task keeps is bounded, whatever the share of the class)
    rated = rated.withColumn("__h", F.xxhash64(F.lit(10), F.col(id_col)))
    top = [rated.where(F.col("__y") == y).orderBy("__h", id_col).limit(2 * SAMPLE_PER_CLASS)
           for y in (0, 1)]
    chosen = saved(top[0].unionByName(top[1]))
    # of the texts of a repeated id the one with the smallest hash
    picked = texts.join(broadcast_if_bounded(chosen, 40), id_col).groupBy(id_col, "__h", "__y") \
        .agg(F.min_by("__x", F.struct(F.xxhash64("__x"), F.col("__x"))).alias("__x"))
    picked = picked.withColumn("rn", F.row_number().over(w)) \
        .where(F.col("rn") <= SAMPLE_PER_CLASS).select("__h", "__y", "__x")
    encoded = map_texts(picked, "__x", ["__h", "__y"], [("x", "array<float>")], _encoded)
    rows = encoded.orderBy("__h", "__y").collect()  # 2 * SAMPLE_PER_CLASS texts at most
    bags = [np.array(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    model = learn(np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, N_FEATURES)),
                  np.array([len(b) for b in bags], np.int64),
                  np.array([r["__y"] for r in rows], np.float64))
    model.share = float(share) if share is not None else 0.5
    return model


def _encoded(col: pa.Array) -> list:
    x, per_text = encode(col)
    edges = np.concatenate(([0], np.cumsum(per_text)))
    return [pa.array([x[a:b].ravel() for a, b in zip(edges, edges[1:])], pa.list_(pa.float32()))]


def score(docs: DataFrame, model: Model, text: str = "text",
          carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all) plus score (0 to 1, higher: label 1 likelier)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(col: pa.Array) -> list:
        return [pa.array(predict(shared.value, col), pa.float64())]
    carry = list(docs.columns) if carry is None else carry
    return map_texts(docs, text, carry, [("score", "double")], fn)
