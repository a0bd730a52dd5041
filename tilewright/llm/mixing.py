"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the exponential key -ln(u) / quality weight (Efraimidis and Spirakis), u from a hash of its id,
so reruns agree. Sorted by key within its source, whole documents are taken while their running size stays within
what the source's budget leaves after complete epochs. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, words_count

#: Documents of a source that share one bucket of keys, about; only a bucket is ever sorted by one task.
BUCKET = 10_000
#: Sources up to which the table of targets is broadcast; beyond it Spark joins by shuffle and splits hot sources.
FEW = 20_000


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """sizes: source, source_size, one row a source. Adds source_rank and target double.

    Sources in order of code points, null last, weigh `weights` in turn and share `share` of all sizes. No target is
    above `cap` times its source; what is above goes to the others by weight until none is above. That end is the level
    L with sum(least(L * weight, cap * size)) = share * total: in order of cap * size / weight the capped sources come first.
    The windows here hold one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("source_rank", F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("most") / F.col("w"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "capped": F.coalesce(F.sum("most").over(by_level), F.lit(0)),
        "w_capped": F.coalesce(F.sum("w").over(by_level), F.lit(0)),
        "total": F.sum("source_size").over(every),
        "w_all": F.sum("w").over(every),
    })
    s = s.withColumn("level", (F.col("total") * F.lit(share) - F.col("capped")) / (F.col("w_all") - F.col("w_capped")))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))).over(every))
    return s.select("source", "source_rank", "source_size", F.least(F.col("level") * F.col("w"), F.col("most").cast("double")).alias("target"))


def unit(doc_id):
    """A number in (0, 1) from a hash of the id."""
    h = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (h + 1) / F.lit(float((1 << 52) + 2))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=(5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """docs: doc_id, source, text. quality: doc_id, weight (positive and finite; else as if missing: 1; several: the largest).

    Returns a row per input row: doc_id, source, size, source_size, target, copies, taken = copies * size. A source's
    taken words differ from its target by half of one document's size at most. Null texts have size 0, null sources are a source,
    repeated rows count each. An empty table gives no rows.
    """
    d = docs.select("doc_id", "source", words_count(F.col("text")).alias("size"))
    if quality is None:
        d = d.withColumn("weight", F.lit(1.0))
    else:
        q = quality.filter("doc_id is not null and weight > 0 and weight < double('infinity')").groupBy("doc_id").agg(F.max("weight").cast("double").alias("weight"))
        d = d.join(q, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    d = keep(d.withColumn("key", -F.log(unit(F.col("doc_id"))) / F.col("weight")), "sized")
    sizes = keep(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    count, largest = sizes.agg(F.count("*"), F.max("n")).first()
    # Buckets of equal width on the keys' logarithm, `fine` to a doubling: so narrow that none holds much more than BUCKET of a source's
    # documents, whatever weights their keys were scaled by.
    fine = max(1, math.ceil((largest or 0) / BUCKET))
    t = targets(sizes.select("source", "source_size"), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s")
    bucket = F.floor(F.log2("key") * fine)
    d = d.join(F.broadcast(t) if count <= FEW else t, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", bucket)
    # Running sums in two levels: of whole buckets, a few rows a source, and within each bucket.
    before = d.groupBy("source_rank", "bucket").agg(F.sum("size").alias("sum")).select("source_rank", "bucket", F.coalesce(F.sum("sum").over(Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source_rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(before, ["source_rank", "bucket"])
    # The document at the budget's end is taken if most of it lies within.
    fits = 2 * (F.col("before") + F.col("within")) + F.col("size") <= 2 * F.col("left")
    d = d.withColumn("copies", F.col("epochs") + F.when(fits, 1).otherwise(0))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs, each as often as mix() takes it. Rows that agree in id, source and size all get the most copies any of them has."""
    m = mix(docs, quality, **options).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    m = m.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "__copies")
    d = docs.withColumn("__words", words_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")) & F.col("source").eqNullSafe(F.col("__source"))
    return d.join(m, same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def label_weights(labels: DataFrame) -> DataFrame:
    """Sampling weights from quality labels: good 2, bad 0.5; whatever has no label stays at 1."""
    return labels.filter("quality is not null").select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


#: What mix() returns for `documents` and label_weights(`labels`), for DuckDB.
SQL = r"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) weight FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT size,
    -ln(((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370498.0::DOUBLE)) / coalesce(weight, 1.0::DOUBLE) AS key
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, sum(size)::BIGINT source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_rank FROM d GROUP BY source),
w AS (SELECT *, CASE source_rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END w, source_size * 2 AS most FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS goal, (sum(w) OVER ())::DOUBLE w_all,
    coalesce(sum(most) OVER o, 0)::DOUBLE capped, coalesce(sum(w) OVER o, 0)::DOUBLE w_capped
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, max(CASE WHEN (goal - capped) / (w_all - w_capped) <= most::DOUBLE / w THEN (goal - capped) / (w_all - w_capped) END) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(level * w, most::DOUBLE) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS copies,
  (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) * size AS taken
FROM r
"""
