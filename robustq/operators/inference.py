"""Batched model inference over (example x variant) pairs (E8 hook).

A model is loaded once per Python worker and reads padded batches of token ids. Rows come in Arrow
batches; within each they are sorted by length and cut into model batches of at most
``batch_ids`` padded ids, so a batch holds rows of about one length, padding stays small and memory
is bounded whatever the texts (a longer single row is a batch of its own). Scores go back in the
order of the rows.

``HashedBag`` is the small model that the registered query learns and serves: mean of learnt class
weights of hashed words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# parameters
BATCH_IDS = 1 << 15   # padded ids of a model batch
PAD = -1
BUCKETS = 256         # hashed words of the bag model

_MODELS: dict = {}    # one model per worker


def worker_model(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of this worker, loaded at its first batch; another model takes its place."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = load()
    return _MODELS[name]


def length_batches(lengths: np.ndarray, batch_ids: int) -> Iterator[np.ndarray]:
    """Row numbers in batches by ascending length whose padded size is within ``batch_ids``."""
    order = np.argsort(lengths, kind="stable")
    sizes = np.maximum(lengths[order], 1).tolist()
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * sizes[end] <= batch_ids:
            end += 1
        yield order[at:end]
        at = end


def padded_rows(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pad: int = PAD) -> np.ndarray:
    """The rows ``flat[start:start + length]`` as one padded matrix, filled at once."""
    out = np.full((len(starts), int(lengths.max(initial=0))), pad, np.int64)
    ends = np.cumsum(lengths)
    take = np.arange(int(lengths.sum())) + np.repeat(starts - (ends - lengths), lengths)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat[take]
    return out


def infer(rows: DataFrame, load: Callable[[], Callable], name: str, n_out: int, ids: str = "ids",
          carry: Sequence[str] = (), out: str = "logits", batch_ids: int = BATCH_IDS, pad: int = PAD) -> DataFrame:
    """The ``carry`` columns and ``out``, the ``n_out`` scores of the model for each row's ids (a
    null row reads no ids). ``load()`` runs in the worker and returns a function from a padded
    matrix of ids to a matrix of scores; ``name`` identifies the model."""
    carry = list(carry)
    inp = rows.select(*carry, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields[:-1]]

    def run(batches):
        model = worker_model(name, load)
        for rb in batches:
            col = rb.column(len(carry))
            flat, offs = np.asarray(col.values), np.asarray(col.offsets)
            scores, lengths = np.zeros((rb.num_rows, n_out)), np.diff(offs).astype(np.int64)
            for b in length_batches(lengths, batch_ids):
                scores[b] = model(padded_rows(flat, offs[b], lengths[b], pad))
            lists = pa.ListArray.from_arrays(np.arange(0, scores.size + 1, n_out, dtype=np.int32),
                                             pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*rb.columns[:len(carry)], lists], names=[*carry, out])

    return inp.mapInArrow(run, ", ".join([*fields, f"`{out}` array<double>"]))


def bucket_ids(words: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of an array of words."""
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


class HashedBag:
    """Scores are the mean of the class weights of a row's word buckets, plus the intercepts."""

    def __init__(self, weights: np.ndarray):
        # the padding reads a last row of zeros
        self.table = np.vstack([weights[:, :-1].T, np.zeros((1, len(weights)))])
        self.bias = weights[:, -1]

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        total = self.table[ids].sum(1)
        return total / np.maximum((ids != PAD).sum(1), 1)[:, None] + self.bias


def bag_features(rows: DataFrame, carry: Sequence[str], ids: str = "ids", buckets: int = BUCKETS) -> DataFrame:
    """The ``carry`` columns and x, each row's share of words per bucket."""
    carry = list(carry)
    inp = rows.select(*carry, F.col(ids).alias("__ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields[:-1]]

    def run(batches):
        for rb in batches:
            col = rb.column(len(carry))
            flat, offs = np.asarray(col.values, np.int64), np.asarray(col.offsets)
            x = np.zeros((rb.num_rows, buckets))
            owner = np.repeat(np.arange(rb.num_rows), np.diff(offs))
            np.add.at(x, (owner, flat[offs[0]:offs[-1]]), 1.0)
            x /= np.maximum(np.diff(offs), 1)[:, None]
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, buckets, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*rb.columns[:len(carry)], lists], names=[*carry, "x"])

    return inp.mapInArrow(run, ", ".join([*fields, "x array<double>"]))


def train_bag(rows: DataFrame, classes: Sequence[str], epochs: int, rate: float = 0.05, key: str = "ex_id",
              ids: str = "ids", label: str = "label", buckets: int = BUCKETS) -> np.ndarray:
    """Weights of a :class:`HashedBag` learnt from labelled rows in mini-batches."""
    from robustq.operators.training import train_softmax
    x = bag_features(rows, [key, label], ids, buckets)
    return train_softmax(x, classes, buckets, epochs, rate=rate, key=key, y=label).weights
