"""Maximum inner product search with score-aware (anisotropic) product quantisation.

Vectors are cut into short subspaces of 16 centres each. Codes and centres minimise a loss that weighs the residual's part parallel to the vector more
than the rest, as that part is what inner products with near queries lose. Four-bit codes, two in a byte, are scanned with
one table look-up a byte; what scores best is ranked anew by exact inner products on the original vectors, and so is every row whose
code leaves open, by a proven bound on its error, that it belongs among the best. Nothing is lost to the codes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Rows of a block of candidates and of queries; a task holds one of each.
CANDIDATES, QUERIES = 16_384, 16_384
CENTRES = 16


class Quantiser:
    """Fitted on a bounded sample (n, dim). Deterministic."""

    def __init__(self, x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 6):
        self.dim, self.width = x.shape[1], width
        self.parts = 2 * math.ceil(x.shape[1] / width / 2)  # even: two codes fill a byte
        self.eta = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        s = self.split(x)
        rng = np.random.default_rng(0)
        pick = rng.permutation(len(x))[:CENTRES] if len(x) >= CENTRES else rng.integers(0, len(x), CENTRES)
        self.centres = s[pick].transpose(1, 0, 2).copy()
        for i in range(rounds):
            codes = self.encode(x, sweeps=0 if i < 3 else 1)
            self.update(x, codes, i >= 3)

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * self.width))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray, sweeps: int = 1) -> np.ndarray:
        """Nearest centres first; each sweep then chooses a subspace's code anew for the whole loss, the others held."""
        s = self.split(x)
        unit = s / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        d2 = ((s[:, :, None, :] - self.centres) ** 2).sum(-1)
        codes = d2.argmin(-1)
        if sweeps:
            along = ((s[:, :, None, :] - self.centres) * unit[:, :, None, :]).sum(-1)
            rows = np.arange(len(x))
            total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
            for _ in range(sweeps):
                for p in range(self.parts):
                    others = total - along[rows, p, codes[:, p]]
                    codes[:, p] = (d2[:, p] + (self.eta - 1) * (others[:, None] + along[:, p]) ** 2).argmin(1)
                    total = others + along[rows, p, codes[:, p]]
        return codes

    def update(self, x: np.ndarray, codes: np.ndarray, aware: bool) -> None:
        """Each centre by its normal equations, the other subspaces' residuals held."""
        s = self.split(x)
        unit = s / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        extra = self.eta - 1 if aware else 0.0
        q = np.stack([self.centres[p][codes[:, p]] for p in range(self.parts)], 1)
        along = ((s - q) * unit).sum(-1)
        for p in range(self.parts):
            others = along.sum(1) - along[:, p]
            u, v = unit[:, p], s[:, p]
            a, b = np.zeros((CENTRES, self.width, self.width)), np.zeros((CENTRES, self.width))
            np.add.at(a, codes[:, p], np.eye(self.width) + extra * u[:, :, None] * u[:, None, :])
            np.add.at(b, codes[:, p], v + extra * u * (others + (u * v).sum(1))[:, None])
            used = np.bincount(codes[:, p], minlength=CENTRES) > 0
            self.centres[p][used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            along[:, p] = ((v - self.centres[p][codes[:, p]]) * u).sum(1)

    def bytes_of(self, x: np.ndarray) -> np.ndarray:
        """(n, parts / 2) bytes, two codes in each."""
        out = np.empty((len(x), self.parts // 2), np.uint8)
        for i in range(0, len(x), 4096):
            c = self.encode(x[i : i + 4096]).astype(np.uint8)
            out[i : i + 4096] = c[:, ::2] << 4 | c[:, 1::2]
        return out

    def slack(self, x: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """(4, n) for vectors x and their bytes: a, 1 / |y|^2, |x - a y| and |x|, where y is what the code stands for and a y the part of x along it."""
        out = np.empty((4, len(x)))
        for i in range(0, len(x), 4096):
            v, c = x[i : i + 4096], np.stack([raw[i : i + 4096] >> 4, raw[i : i + 4096] & 15], 2).reshape(-1, self.parts)
            y = self.centres[np.arange(self.parts), c].reshape(len(v), -1)[:, : self.dim]
            y2 = (y * y).sum(1)
            inverse = np.divide(1.0, y2, out=np.zeros(len(v)), where=y2 > 0)
            a = (v * y).sum(1) * inverse
            out[:, i : i + 4096] = a, inverse, np.linalg.norm(v - a[:, None] * y, axis=1), np.linalg.norm(v, axis=1)
        return out

    def at_most(self, near: np.ndarray, table: np.ndarray, q: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """What the inner products of q can be at most, given the scan's scores: <q, x> = a <q, y> + <q', x - a y>, q' the part of q across y,
        and the last term is at most |q'| |x - a y|. Allows for the rounding of the scan and of this sum; not-a-number where numbers are too large."""
        a, inverse, rest, norm = slack
        n, length = near.astype(np.float64), np.linalg.norm(q)
        off = self.parts * (np.abs(table).max(1).sum(dtype=np.float64) * 2.0**-23 + 2.0**-149)
        across = np.sqrt(np.maximum(0.0, length**2 - np.maximum(0.0, np.abs(n) - off) ** 2 * inverse))
        return a * n + np.abs(a) * off + rest * across + 1e-7 * length * norm

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts / 2, 256): what each byte adds to the score."""
        t = np.einsum("npw,pcw->npc", self.split(q), self.centres)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), self.parts // 2, 256).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (an array as in the input): rows with an id and a vector of the table's most common length, without nulls, not-a-numbers and infinities, and not all zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter("vec_id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.coalesce(good, F.lit(False)))
    dim = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("v") == (dim["d"] if dim else 1))


def flat(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def first_of_equal(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows, sorted by id, that can be among the k nearest of any query: of equal vectors the first k + 1, as a query
    leaves out one row, its own. The others come after k rows of their own score."""
    held: dict[bytes, int] = {}
    out = []
    for i, v in enumerate(x):
        n = held[b] = held.get(b := v.tobytes(), 0) + 1
        if n <= k + 1:
            out.append(i)
    return np.array(out, np.int64)


def in_order(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, summed from the first component to the last, so that a score does not depend on which rows are scored together."""
    return np.cumsum(x * q, 1)[:, -1] if len(x) else np.zeros(0)


def search(vectors: DataFrame, every: int, k: int = 20, rerank: int = 256, sample: int = 12_000) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: the k nearest of each row whose vec_id is divisible by `every`, among all rows but itself.

    Rows that share an id are queries and candidates each for itself; query_row (any number, a row's own) tells them apart. Ties go to smaller ids. Tables without
    usable vectors give no rows; null ids take no part; other columns are left out whatever their names.

    The quantiser is fitted on at most `sample` vectors, those of the smallest id hash; every row is indexed and scanned. In each block of
    CANDIDATES rows `rerank` of the best by the scan are scored exactly, then all others that can reach the k-th score found by the bound on
    their code's error; so the k are the true ones, whatever the table holds. Equal vectors of a block are scanned
    as far as they can be among the k. Queries and candidates meet block by block, in their own precision with the codes; only the best k of each block are shuffled on.
    """
    v = keep(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    kind = np.dtype("<f4" if v.schema["v"].dataType.elementType.simpleString() == "float" else "<f8")
    drawn = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.col("v").cast("array<double>").alias("v")).toPandas()["v"]
    if not len(drawn):
        return v.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0D as score", "row as query_row")
    q = Quantiser(np.stack(drawn.to_list()))
    n, n_queries = v.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    c_blocks, q_blocks = math.ceil(n / CANDIDATES), max(1, math.ceil(n_queries / QUERIES))

    def index(batches):
        for b in batches:
            if b.num_rows:
                x = flat(b.column(2))
                codes = q.bytes_of(x.astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())], ["row", "vec_id", "v", "codes"])

    def matrix(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(len(t), -1).astype(np.float64)

    h = F.xxhash64("row")
    vector = v.select("row", "vec_id", "v" if kind.itemsize == 4 else F.col("v").cast("array<double>").alias("v"))
    indexed = vector.mapInArrow(index, "row long, vec_id long, v binary, codes binary")
    blocks = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = indexed.withColumn("c", F.pmod(h, F.lit(c_blocks)).cast("int")).withColumn("q", blocks(q_blocks))
    right = indexed.drop("codes").filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("q", F.pmod(h, F.lit(q_blocks)).cast("int")).withColumn("c", blocks(c_blocks))

    def scan(cands: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(cands) and len(queries):
            ids, rows, x = cands.column("vec_id").to_numpy(), cands.column("row").to_numpy(), matrix(cands)
            qs, query_ids, query_rows = matrix(queries), queries.column("vec_id").to_numpy(), queries.column("row").to_numpy()
            order = np.lexsort((rows, ids))
            order = order[first_of_equal(x[order], k)]
            ids, rows, x = ids[order], rows[order], x[order]
            raw = np.frombuffer(b"".join(cands.column("codes").to_pylist()), np.uint8).reshape(len(cands), -1)[order]
            codes, slack = raw.T.astype(np.intp), q.slack(x, raw)
            longest = np.sqrt((x * x).sum(1)).max()
            out = [[], [], [], []]
            for i in range(0, len(qs), 64):
                tables = q.tables(qs[i : i + 64])
                for j, t in enumerate(tables):
                    query = qs[i + j]
                    near = t[0].take(codes[0])
                    for p in range(1, len(codes)):
                        near += t[p].take(codes[p])
                    open_ = rows != query_rows[i + j]
                    most = q.at_most(near, t, query, slack)
                    near[~open_] = -np.inf
                    top = np.argpartition(-near, rerank)[:rerank] if len(near) > rerank else np.arange(len(near))
                    top = top[open_[top]]
                    exact = x[top] @ query
                    # Rounding of sums: those in another order differ by less.
                    least = np.partition(exact, -k)[-k] - 1e-12 * longest * np.linalg.norm(query) if len(exact) >= k else -np.inf
                    open_[top] = False
                    more = np.flatnonzero(open_ & ~(most < least))
                    top, exact = np.concatenate([top, more]), np.concatenate([exact, x[more] @ query])
                    if len(exact) > k:
                        least = np.partition(exact, -k)[-k] - 1e-12 * longest * np.linalg.norm(query)
                        top = top[~(exact < least)]
                    exact = in_order(x[top], query)
                    best = np.lexsort((top, -exact))[:k]
                    out[0].append(np.full(len(best), query_rows[i + j]))
                    out[1].append(np.full(len(best), query_ids[i + j]))
                    out[2].append(ids[top[best]])
                    out[3].append(exact[best])
            out = [np.concatenate(o) for o in out]
        return pa.table({"query_row": pa.array(out[0], pa.int64()), "query_id": pa.array(out[1], pa.int64()), "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(scan, "query_row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


#: The same for `embeddings` with every = 20 and k = 20 by all inner products, for DuckDB.
SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER () AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
