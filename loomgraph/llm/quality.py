"""Quality classifier: Bradley-Terry ranking on preference pairs, thresholded by a score quantile.

Each text becomes a few features of its bytes, words and lines.  Of labelled rows, pairs (good, bad) are drawn, and
scores w.x are learnt by logistic loss on feature differences: P(good preferred) = sigmoid(w.(x_good - x_bad)).  No
intercept can be learnt from pairs; the threshold is the quantile of the training scores that leaves the share of
bad labels below it.  It is mapped to ``cut``, so score = sigmoid(w.x - threshold + logit(cut)).

Training uses at most ``max_train`` labelled rows, those with the smallest hash of the id (a documented bound; the
model has some twenty numbers).  Their ids are broadcast to select their texts.  Scoring is one pass over all texts.

Defined results: null text counts as empty and is scored like any text; without labels of both kinds every score is
0.5; labels that contradict each other, null labels and null ids are not learnt from; the id, other columns and the
labels never enter a score.  Repeated rows are scored alike.  All columns of docs are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"-?()", b"!", b"|", b"#$%&*", b"@/\\<>{}[]=_+^~`", bytes(range(128, 256))]
_OF_BYTE = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _OF_BYTE[list(_c), _k] = 1


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "replace")
    n = max(len(data), 1)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _OF_BYTE / n
    words = data.split()
    m = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x]
    k = max(len(lines), 1)
    caps = share[1] / max(share[0] + share[1], 1e-9)
    distinct = len(set(words)) / m
    rest = np.array([caps, n / m / 10, np.log1p(m) / 10, distinct, distinct * np.log1p(m) / 10, len(set(lines)) / k, len(lines) / m, float(not words)])
    marks = np.array([share[6], share[7], share[8]]) * n / m  # a word's share of marks, whatever its length
    return np.concatenate([share, rest, np.minimum(marks, 3), np.sqrt(share[[1, 2, 6, 7, 8, 9]])])


N_FEATURES = len(features(""))


def train(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, feature means, threshold) on standardised features folded into the weights."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(N_FEATURES), np.zeros(N_FEATURES), 0.0
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps on a convex loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    share = (y == 0).mean()
    low, high = np.quantile(s, [max(share - 0.5 / len(s), 0), min(share + 0.5 / len(s), 1)])
    return w / scale, mean, float((low + high) / 2)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_filter: str | None = None, cut: float = 0.3, max_train: int = 20_000) -> DataFrame:
    """docs with score double (a column of that name is replaced).  train_filter: SQL on id_col, which labelled rows may be learnt from."""
    clean = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    clean = clean.filter(train_filter) if train_filter else clean
    clean = clean.groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).filter("y = y2").select(id_col, "y")
    chosen = clean.orderBy(F.xxhash64(id_col), id_col).limit(max_train)

    def measure(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["y", "x", "h"])

    sample = docs.select(id_col, F.col(text_col).alias("t")).join(F.broadcast(chosen), id_col).select("y", "t", F.xxhash64(id_col).alias("h"))
    got = sample.mapInArrow(measure, "y int, x array<double>, h long").orderBy("h", "x").limit(max_train).collect()  # also where ids repeat
    got.sort(key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in got]).reshape(-1, N_FEATURES)
    w, mean, threshold = train(x, np.array([r.y for r in got], int))
    shift = np.log(cut / (1 - cut)) if np.any(w) else 0.0

    kept = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))]).reshape(-1, N_FEATURES)
            s = 1 / (1 + np.exp(-np.clip((x - mean) @ w - threshold + shift, -500, 500)))
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(run, schema)
