"""Quality scores: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, each chosen pair of features one over pairs of bins. The tables are
learned by cyclic boosting: round after round, feature after feature, a shallow tree over the feature's bins is fitted
to the residuals and added to its table at a small rate; pairs follow once the single features are learned. A score
is the sum of table entries, looked up for whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, worker

NAMES = ["chars", "words", "word_len", "upper", "digit", "odd_symbols", "bang", "pipe", "other_ascii", "beyond_ascii", "space", "lines", "line_len", "repeated_lines", "distinct_words", "long_words", "stops", "caps_words", "odd_ends", "longest_word"]
LETTERS = np.zeros(256, int)
#: Which of the byte classes below a byte falls in.
for _i, _set in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~\\`<>{}[]=+_", b"!?", b"|", b"\"'()-/:;", bytes(range(128, 256)), b" \t\n\r\v\f", b".,"], 1):
    LETTERS[list(_set)] = _i


def features(text: str | None) -> list[float]:
    """Of a whole text, in time in proportion to its length. Null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(LETTERS, np.bincount(raw, minlength=256), 10)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, w = max(1, len(raw)), max(1, len(words))
    upper, digit, odd, bang, pipe, other, beyond, space, stops = counts[1:] / n
    ends = sum(not x[-1].isalnum() and x[-1] not in ".,;:" for x in words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, upper, digit, odd, bang, pipe, other, beyond, space,
        np.log1p(len(lines)), np.log1p(len(words) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / w ** 0.8,
        sum(len(x) > 14 for x in words) / w, stops, sum(map(str.isupper, words)) / w, ends / w, np.log1p(max(map(len, words), default=0)),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(x) for x in texts], float).reshape(len(texts), len(NAMES))


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        b = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[j]]
        c = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for p in self.pairs for j in p}
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[c[i], c[j]]
        return 1 / (1 + np.exp(-z))


def cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 2.0) -> np.ndarray:
    """A tree of a few leaves over ordered bins: a Newton step for each bin, from gradient and curvature sums."""
    spans, G, H = [(0, len(g))], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    while len(spans) < leaves:
        best = (1e-9, None)
        for s, (a, b) in enumerate(spans):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = (G[m] - G[a]) ** 2 / (H[m] - H[a] + ridge) + (G[b] - G[m]) ** 2 / (H[b] - H[m] + ridge) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (s, int(m[k])))
        if best[1] is None:
            break
        s, m = best[1]
        a, b = spans[s]
        spans[s : s + 1] = [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """A tree of four leaves over a grid: one cut across, each side cut again the other way."""
    best, out = -1.0, np.zeros(g.shape)
    for turned in (False, True):
        G, H = (g.T, h.T) if turned else (g, h)
        up = [np.cumsum(x, 0) for x in (G, H)]
        for m in range(1, len(G)):
            parts, gain = [], 0.0
            for gg, hh in ((up[0][m - 1], up[1][m - 1]), (up[0][-1] - up[0][m - 1], up[1][-1] - up[1][m - 1])):
                t = shallow_tree(gg, hh, 2, ridge)
                gain += float(np.sum(t * gg))
                parts.append(t)
            if gain > best:
                t = np.concatenate([np.tile(parts[0], (m, 1)), np.tile(parts[1], (len(G) - m, 1))])
                best, out = gain, t.T if turned else t
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15) -> Model:
    """Deterministic. Rows of one class only, or none, give a constant score."""
    y = y.astype(float)
    p = (y.sum() + 1) / (len(y) + 2)
    base, d = float(np.log(p / (1 - p))), len(NAMES)
    if not len(y) or y.min() == y.max():
        return Model([np.zeros(0)] * d, base, [np.zeros(1)] * d, [np.zeros(0)] * d, [], [])
    edges, coarse = [cuts(x[:, j], bins) for j in range(d)], [cuts(x[:, j], 12) for j in range(d)]
    b = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    c = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    tables, z = [np.zeros(len(e) + 1) for e in edges], np.full(len(y), base)
    for _ in range(rounds):
        for j in range(d):
            q = 1 / (1 + np.exp(-z))
            step = rate * shallow_tree(np.bincount(b[j], y - q, len(tables[j])), np.bincount(b[j], q * (1 - q), len(tables[j])))
            tables[j] += step
            z += step[b[j]]

    def grid(i, j):
        q = 1 / (1 + np.exp(-z))
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = c[i] * shape[1] + c[j]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - q, q * (1 - q)))

    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            _, g, h = grid(i, j)
            gains.append((-float(np.sum(pair_tree(g, h) * g)), i, j))
    pairs = [(i, j) for _, i, j in sorted(gains)[:n_pairs]]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(pairs):
            cell, g, h = grid(i, j)
            step = rate * pair_tree(g, h)
            pair_tables[k] += step
            z += step.ravel()[cell]
    return Model(edges, base, tables, coarse, pairs, pair_tables)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 12_000) -> Model:
    """Fit on at most `sample` labelled documents, those of the smallest hash of doc_id: a documented bound, the same rows
    on every run. Null labels, null ids and the held-out fifth are never looked at. A document with both labels has
    the larger. Only the sample's texts are read in full; ids of a bounded sample are broadcast."""
    known = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("y")).filter("labelled is not null and y in (0, 1)")
    known = known.filter(~held_out(F.col("labelled"))).groupBy("labelled").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)

    def f(batches):
        with worker("quality"):
            for b in parts(batches, 2):
                x = matrix(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "y", "text").mapInArrow(f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").collect()
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    return fit(np.array([r[2] for r in rows], float).reshape(len(rows), len(NAMES)), np.array([r[1] for r in rows], int))


def score(docs: DataFrame, model: Model, cols: list[str] = ("doc_id",)) -> DataFrame:
    """cols and score double (0 to 1) of every row; null and empty texts get the score their features give."""
    inputs = docs.select(*cols, F.col("text").alias("__text"))
    schema = ", ".join(f"`{c}` {inputs.schema[c].dataType.simpleString()}" for c in cols) + ", score double"

    def f(batches):
        with worker("quality"):
            for b in parts(batches, len(cols)):
                s = model.score(matrix(b.column(len(cols)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    return inputs.mapInArrow(f, schema)


def select_good(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, all columns as they are."""
    text = docs.columns.index("text")

    def f(batches):
        with worker("quality"):
            for b in parts(batches, text):
                yield b.filter(pa.array(model.score(matrix(b.column(text).to_pylist())) >= threshold))

    return docs.mapInArrow(f, docs.schema)
