"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets.

Two collections of `groups` short MinHash groups (`rows` hashes each) are computed per set. Table (i, j) has as its key
group i of the first collection with group j of the second: groups**2 tables of 2 * rows hashes from 2 * groups * rows
hashes in all. Two sets of similarity s miss each other in every table where they share no group of one of the two collections, with
probability 1 - (1 - (1 - s**rows)**groups)**2. With 12 groups of 3 that is 2.2e-5 at 0.85 and 3.6e-4 at 0.8.

Equal sets are one class from the start, so copies never meet. Table keys are only built from groups that another class has too, which
leaves all but near copies out before the tables are dealt. In a bucket all members are compared with one pivot, so work is linear in the
bucket, and those linked with it are settled. Where a pivot's members still lie in several components, those
not linked with it are searched against all its members, in blocks: a task holds two blocks and gives out links alone. Every pair of
a bucket is thus linked with its pivot on both sides, known to be in one component, or compared on full sets; there is no cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, drop_kept, keep, parts, worker

MIX = np.uint64(0x9E3779B97F4A7C15)
P1, P2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_words = Memo(xxhash.xxh3_64_intdigest)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * P2
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, A-Z in lower case; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - size + 1)
    h = np.full(n, np.uint64(min(size, len(ids))), np.uint64)
    for i in range(min(size, len(ids))):
        h = h * P1 + ids[i : i + n]
    return np.unique(mix(h))


def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240501)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def sketches(sets: list[np.ndarray], groups: int, rows: int) -> np.ndarray:
    """(sets, 2 * groups) group hashes; sets must not be empty."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    a, b = factors(2 * groups * rows)
    out = np.empty((len(sets), 2 * groups), np.uint64)
    for g in range(2 * groups):
        key = np.full(len(sets), np.uint64(g + 1))
        for i in range(g * rows, (g + 1) * rows):
            key = mix(key * MIX + np.minimum.reduceat(flat * a[i] + b[i], starts))
        out[:, g] = key
    return out


SKETCH = "doc_id long, n_shingles long, lo long, hi long, a array<long>, b array<long>"


def sketch(docs: DataFrame, size: int, groups: int, rows: int) -> DataFrame:
    """A row per document; lo and hi name its set."""

    def part(ids, texts):
        sets = [shingles(t, size) for t in texts]
        full = [s for s in sets if len(s)]
        k = sketches(full, groups, rows).view(np.int64) if full else np.zeros((0, 2 * groups), np.int64)
        at = np.cumsum([len(s) > 0 for s in sets]) - 1
        pick = lambda cut: [k[at[i], cut].tolist() if len(s) else [] for i, s in enumerate(sets)]
        total = lambda f: pa.array(np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(s) for s in sets], pa.int64()), total(lambda s: s), total(lambda s: mix(s * P1)), pa.array(pick(slice(0, groups)), pa.list_(pa.int64())), pa.array(pick(slice(groups, None)), pa.list_(pa.int64()))],
            [x.split()[0] for x in SKETCH.split(", ")],
        )

    def f(batches):
        with worker("near_dup", _words.forget):
            for b in parts(batches, 1):
                yield part(b.column(0), b.column(1).to_pylist())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(f, SKETCH)


def set_table(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """rep, set binary (sorted 64-bit hashes) of the documents in reps."""

    def f(batches):
        with worker("near_dup", _words.forget):
            for b in parts(batches, 1):
                sets = [shingles(t, size).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(reps, "rep", "left_semi")
    return texts.mapInArrow(f, "rep long, set binary")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y, linked of pairs, on their full sets: 100 * intersection >= percent * union. A pivot's set is joined to its pairs; Spark splits hot pivots."""

    def f(batches):
        with worker("near_dup"):
            for b in batches:
                linked = []
                for s, t in zip(b.column(2), b.column(3), strict=True):
                    s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                    both = shared_count(s, t)
                    linked.append(100 * both >= percent * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["x", "y", "linked"])

    with_y = pairs.join(sets.select(F.col("rep").alias("y"), F.col("set").alias("set_y")), "y")
    both = with_y.join(sets.select(F.col("rep").alias("x"), F.col("set").alias("set_x")), "x").select("x", "y", "set_x", "set_y")
    return both.mapInArrow(f, "x long, y long, linked boolean")


def shared_count(s: np.ndarray, t: np.ndarray) -> int:
    return int(np.count_nonzero(s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t))


def pivoted(buckets: DataFrame) -> DataFrame:
    """key, x, y: each member of a bucket with the bucket's smallest."""
    pivot = buckets.groupBy("key").agg(F.min("rep").alias("x"))
    return buckets.join(pivot, "key").filter("rep != x").select("key", "x", F.col("rep").alias("y"))


#: Members of a block.
BLOCK = 512


def intersections(u: list[np.ndarray], v: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of sorted sets u and v: products of their membership matrices, some columns at a time."""
    fu, fv = np.concatenate(u), np.concatenate(v)
    ru, rv = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (u, v))
    common = np.intersect1d(fu, fv)
    iu, iv = np.searchsorted(common, fu), np.searchsorted(common, fv)
    ku, kv = (common[np.minimum(i, len(common) - 1)] == f if len(common) else np.zeros(len(f), bool) for i, f in ((iu, fu), (iv, fv)))
    (iu, ru), (iv, rv) = (iu[ku], ru[ku]), (iv[kv], rv[kv])
    (iu, ru), (iv, rv) = ((i[o], r[o]) for i, r, o in ((iu, ru, np.argsort(iu, kind="stable")), (iv, rv, np.argsort(iv, kind="stable"))))
    out = np.zeros((len(u), len(v)), np.float32)
    for at in range(0, len(common), width):
        n = min(width, len(common) - at)
        m = []
        for i, r, rows in ((iu, ru, len(u)), (iv, rv, len(v))):
            a, b = np.searchsorted(i, [at, at + n])
            x = np.zeros((rows, n), np.float32)
            x[r[a:b], i[a:b] - at] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


def block_links(m: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y: links between members of one pivot that are in different components, one of them not linked with the pivot.
    m: x, y, component, linked."""
    sizes = m.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nv"), F.ceil(F.count_if(~F.col("linked")) / BLOCK).cast("int").alias("nu")).filter("nu > 0")
    d = m.join(sizes, "x").join(sets.withColumnRenamed("rep", "y"), "y").select("x", "y", "component", "linked", "set", "nu", "nv")
    block = lambda n: F.pmod(F.xxhash64("y", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["x", "i", "j", "y", "component", "set"]
    u = d.filter(~F.col("linked")).withColumn("i", block("nu")).withColumn("j", every("nv")).select(*(F.col(c).alias(c) for c in columns))
    v = d.withColumn("j", block("nv")).withColumn("i", every("nu")).select(*(F.col(c).alias(c) for c in columns))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if len(left) and len(right):
            (su, yu, cu), (sv, yv, cv) = (([np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("set")], t.column("y").to_numpy(), t.column("component").to_numpy()) for t in (left, right))
            nu, nv = np.array([len(s) for s in su]), np.array([len(s) for s in sv])
            ask = (cu[:, None] != cv) & (100 * np.minimum(nu[:, None], nv) >= percent * np.maximum(nu[:, None], nv))
            # By pairs where few are asked for, else all at once.
            if 40 * ask.sum() < len(su) * len(sv):
                both = np.zeros(ask.shape, np.int64)
                for i, j in zip(*np.nonzero(ask), strict=True):
                    both[i, j] = shared_count(su[i], sv[j])
            else:
                both = intersections(su, sv)
            i, j = np.nonzero(ask & (100 * both >= percent * (nu[:, None] + nv - both)))
            a, b = np.minimum(yu[i], yv[j]), np.maximum(yu[i], yv[j])
        return pa.table({"x": pa.array(a, pa.int64()), "y": pa.array(b, pa.int64())})

    return u.groupBy("x", "i", "j").cogroup(v.groupBy("x", "i", "j")).applyInArrow(search, "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of the edges x, y.

    Every node takes its smallest neighbour as parent if that is smaller; parents are followed to their ends by doubling; edges
    are then drawn between those ends, and so on until none is left. A round more than halves the nodes. All tables stay in Spark.
    """
    e = keep(edges.filter("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    out = None
    while not e.isEmpty():
        ends = e.select(F.col("x").alias("node"), F.col("y").alias("other")).unionByName(e.select(F.col("y").alias("node"), F.col("x").alias("other")))
        p, moved = keep(ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent")), "parents"), True
        while moved:
            q = p.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            p2 = keep(p.join(q, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
            drop_kept(p)
            p, moved = p2.select("node", "parent"), not p2.filter("moved").isEmpty()
        x, y = p.select(F.col("node").alias("x"), F.col("parent").alias("px")), p.select(F.col("node").alias("y"), F.col("parent").alias("py"))
        e2 = keep(e.join(x, "x").join(y, "y").filter("px != py").select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "edges")
        drop_kept(e)
        e = e2
        if out is None:
            out = p.withColumnRenamed("parent", "component")
        else:
            up = p.select(F.col("node").alias("component"), "parent")
            out2 = keep(out.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
            drop_kept(out, p)
            out = out2
    return out if out is not None else e.select(F.col("x").alias("node"), F.col("y").alias("component"))


def shared(keys: DataFrame) -> DataFrame:
    """Rows rep, key whose key another rep has too."""
    many = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key")
    return keys.join(many, "key", "left_semi")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, groups: int = 12, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    component_id: the smallest doc_id linked with the document, over any number of links, itself included. Documents
    without words are linked with nothing; null ids have a null component and are kept; rows that share an id are one document with
    several sets. An empty table gives no rows.
    """
    sk = keep(sketch(docs, size, groups, rows), "sketches")
    name = ["n_shingles", "lo", "hi"]
    usable = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = keep(usable.groupBy(*name).agg(F.min(F.struct("doc_id", "a", "b")).alias("m"), F.max("doc_id").alias("last")).select(F.col("m.doc_id").alias("rep"), *name, "last", "m.a", "m.b"), "classes")
    side = lambda c: keep(shared(classes.select("rep", F.explode(c).alias("key"))), f"shared-{c}")
    a, b = side("a"), side("b")
    buckets = keep(shared(a.join(b.select("rep", F.col("key").alias("key_b")), "rep").select("rep", F.xxhash64("key", "key_b").alias("key")).distinct()), "buckets")
    sets = keep(set_table(docs, buckets.select("rep").distinct(), size), "sets")
    drop_kept(a, b)

    # Rows that share an id hold several classes together.
    edges = keep(usable.join(classes.select("rep", *name), name).filter("rep != doc_id").join(classes.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("rep").alias("x"), F.col("doc_id").alias("y")).distinct(), "links")
    members = pivoted(buckets)
    seen = keep(compare(members.select("x", "y").distinct(), sets, percent), "compared")
    links = keep(edges.unionByName(seen.filter("linked").select("x", "y")).distinct(), "links")
    comp = components(links)
    # What is left of a bucket matters where it lies in several components, not all linked with the pivot.
    m = members.join(seen, ["x", "y"]).join(comp.select(F.col("node").alias("y"), "component"), "y", "left").withColumn("component", F.coalesce("component", "y"))
    open_ = m.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.bool_and("linked").alias("settled")).filter("low < high and not settled").select("key")
    m = keep(m.join(open_, "key", "left_semi").select("x", "y", "component", "linked").distinct(), "open")
    more = keep(block_links(m, sets, percent), "more-links")
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    drop_kept(buckets, sets, edges, seen, links, m, more)
    # Only classes with several documents or with links need the joins.
    of_class = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").filter("last != rep or component is not null").select(*name, F.coalesce("component", "rep").alias("component"))
    out = sk.select("doc_id", *name).join(of_class, name, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
