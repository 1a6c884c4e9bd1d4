"""Quality by a generalised additive model with pairwise interactions (operator 3).

Features are counts and shares of whole texts, binned at quantiles. Boosting
goes round the features: each step fits a tree of at most four leaves to one
feature's bins and adds it, shrunk, to that feature's lookup table. Then the
pairs of features whose residuals gain most from a coarse two-way table are
boosted the same way, one cut in each direction. A score is the sum of one
table entry for each feature and pair, found by bin numbers, for a whole batch
at a time.

The model is fitted on the driver from at most ``FIT_ROWS`` labelled rows, by
the hash of their ids; the tables have a fixed size.

Defined cases: null and empty texts have all features 0 and are scored too;
without labels of both classes every score is the share of label 1, or 0.5;
rows that repeat are scored alike; labels, language, source and id are no
features; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import remainder, sample
from .rules import base_counts

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
FEATURES = ("log_bytes", "log_words", "word_length", "upper", "marks", "symbols", "bars", "digits", "distinct", "repeated", "stutter", "dup_lines", "line_words", "zstd")
BINS, COARSE, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 48, 8, 8, 60, 30, 0.2


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The features (documents x FEATURES) of a chunk."""
    n = len(offs) - 1
    size = np.diff(offs)
    base = base_counts(data, offs)
    words = np.maximum(base["n_words"], 1)
    total = np.maximum(size, 1)

    def count(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(hit)))
        return sums[offs[1:]] - sums[offs[:-1]]

    upper = count((data >= 65) & (data <= 90))
    lower = count(((data >= 97) & (data <= 122)) | (data >= 0xC0))
    starts, ends, doc = X.words(data, offs)
    h = X.span_hash(data, starts, ends)
    distinct = np.diff(X.distinct_by_doc(h, doc, n)[1])
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pack = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False)
    raw = memoryview(np.ascontiguousarray(data))
    zstd = np.array([len(pack.compress(raw[offs[k] : offs[k + 1]])) / size[k] if size[k] else 0.0 for k in range(n)])
    lines = count(data == 0x0A) + 1
    out = [
        np.log1p(size), np.log1p(base["n_words"]), base["word_chars"] / words, upper / np.maximum(upper + lower, 1), count((data == 0x21) | (data == 0x3F)) / words,
        base["n_symbols"] / words, count(data == 0x7C) / words, count((data >= 48) & (data <= 57)) / total, distinct / words, base["n_repeat_words"] / words,
        np.bincount(doc[same], minlength=n) / words, base["n_dup_lines"] / lines, base["n_words"] / lines, np.minimum(zstd, 2.0),
    ]
    return np.stack(out, axis=1).astype(float)


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edge, x[:, k], "right")]
        for i, j, ei, ej, table in self.pairs:
            z += table[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, least: float = 5.0, ridge: float = 1.0) -> np.ndarray:
    """Newton values by bin of a tree over ordered bins, grown best split first."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(parts) < leaves:
        best = (1e-6, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gain = worth(a, cut) + worth(cut, b) - worth(a, b)
            gain[(ch[cut] - ch[a] < least) | (ch[b] - ch[cut] < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, int(cut[at]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The gain and values of the best table with one cut in each direction."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    best, out = 0.0, np.zeros_like(g)
    whole = cg[n, m] ** 2 / (ch[n, m] + ridge)
    for a in range(1, n):
        for b in range(1, m):
            gain, cells = -whole, []
            for x0, x1, y0, y1 in ((0, a, 0, b), (0, a, b, m), (a, n, 0, b), (a, n, b, m)):
                sg = cg[x1, y1] - cg[x0, y1] - cg[x1, y0] + cg[x0, y0]
                sh = ch[x1, y1] - ch[x0, y1] - ch[x1, y0] + ch[x0, y0]
                gain += sg * sg / (sh + ridge)
                cells.append((x0, x1, y0, y1, sg / (sh + ridge)))
            if gain > best:
                best, out = gain, np.zeros_like(g)
                for x0, x1, y0, y1, v in cells:
                    out[x0:x1, y0:y1] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of y (0 or 1) by x (rows x features)."""
    width = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))) if len(y) else 0.0, [np.zeros(0)] * width, [np.zeros(1) for _ in range(width)], [])
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_quantiles(x[:, k], BINS) for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(model.edges[k], x[:, k], "right") for k in range(width)]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for k in range(width):
            p = 1 / (1 + np.exp(-z))
            n = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins[k], y - p, n), np.bincount(bins[k], p * (1 - p), n))
            model.tables[k] += step
            z += step[bins[k]]
    coarse = [_quantiles(x[:, k], COARSE) for k in range(width)]
    place = [np.searchsorted(coarse[k], x[:, k], "right") for k in range(width)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        n, m = len(coarse[i]) + 1, len(coarse[j]) + 1
        at = place[i] * m + place[j]
        return np.bincount(at, y - p, n * m).reshape(n, m), np.bincount(at, p * (1 - p), n * m).reshape(n, m)

    gains = sorted(((_quarters(*sums(i, j))[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:PAIRS] if gain > 1.0]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in model.pairs:
            step = RATE * _quarters(*sums(i, j))[1]
            table += step
            z += step[place[i], place[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, text: str = "text", key: str = "doc_id") -> Model:
    """The model of at most ``rows`` labelled documents; their features come to the driver."""
    known = sample(docs, labels, label, rows, text, key)

    def run(batches):
        for b in batches:
            for i, j, data, offs in X.chunks(b.column(0)):
                x = features(data, offs)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), flat], names=["y", "x"])

    got = known.select(text, "y").mapInArrow(run, "y int, x array<double>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    x = got.column("x").combine_chunks().flatten().to_numpy() if len(y) else np.zeros(0)
    x = x.reshape(-1, len(FEATURES))
    order = np.lexsort((y, *x.T))  # the rows come in any order
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, least: float = 0.7, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with columns score and predicted; columns of these names are replaced."""
    docs = docs.drop(name, "predicted")
    at, names = docs.columns.index(text), docs.columns

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = np.concatenate([model.score(features(data, offs)) for _, _, data, offs in X.chunks(b.column(at))])
                s = np.round(s, 9)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= least).astype(np.int32))], names=[*names, name, "predicted"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality of every document; the model has not seen the fold with remainder 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.filter(remainder("doc_id", 4) != 2))
    return score(docs.withColumn("held_out", remainder("doc_id", 4) == 2), model).select("doc_id", "held_out", "score", "predicted")
