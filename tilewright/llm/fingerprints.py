"""SimHash fingerprints and the search for near ones. DataFrame operations only.

Terms are pairs of neighbouring words. A term's 64-bit hash votes on each bit with the term's weight, its length in
characters (16 at most) for each time it occurs. Two bits are counted in the two halves of one long, so 32 sums in generated code hold
all votes; a document's rows meet in the task's own partial aggregate.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, keep, shuffle_partitions

BITS = 64
HEAVIEST = 16
_TWO = (1 << 32) | 1


def with_words(df: DataFrame, col: str, name: str) -> DataFrame:
    """Adds the array of words. A column of its own: Spark then splits a text once, not once for each use."""
    return df.withColumn(name, F.array_remove(F.split(F.col(col), GAP), ""))


def terms(words: str):
    """Array of (h, w): hash and weight of each word with the word after it; the last one stands alone."""
    width = lambda x, y: F.least(F.lit(HEAVIEST), F.length(x) + F.coalesce(F.length(y), F.lit(0))).cast("long")
    return F.zip_with(F.col(words), F.slice(F.col(words), F.lit(2), F.size(words)), lambda x, y: F.struct(F.xxhash64(x, y).alias("h"), width(x, y).alias("w")))


def vote_sums(h="h", w="w"):
    """Aggregates b0 to b31 and weight over rows of terms."""
    return [F.sum(F.col(w) * F.shiftrightunsigned(F.col(h), j).bitwiseAND(F.lit(_TWO))).alias(f"b{j}") for j in range(32)] + [F.sum(w).alias("weight")]


def fingerprint():
    """The fingerprint (long) from vote_sums(): a bit is set if more than half of the weight votes for it; none without terms."""
    out = F.lit(0).cast("long")
    for j in range(BITS):
        b = F.col(f"b{j % 32}")
        ones = b.bitwiseAND(F.lit(0xFFFFFFFF)) if j < 32 else F.shiftrightunsigned(b, 32)
        out = out.bitwiseOR(F.shiftleft(F.when(2 * ones > F.col("weight"), 1).otherwise(0).cast("long"), j))
    return out


def likeness(a, b):
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long, one row per different (doc_id, text). Null texts count as empty, with fingerprint 0."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    e = with_words(d, "text", "words").select("doc_id", "th", F.explode_outer(terms("words")).alias("t")).select("doc_id", "th", "t.h", "t.w")
    return e.groupBy("doc_id", "th").agg(*vote_sums()).select("doc_id", fingerprint().alias("fp"))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, prev_id, prev_quarter for every different id: the next and previous ids in ascending order (the last's next is
    the first), and a quarter of the previous document's length. Rows of ids and lengths only: they are dealt out by range,
    and each part needs its neighbour parts' border rows, of which there is one a part."""
    spark = docs.sparkSession
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("int").alias("quarter"))
    dealt = keep(ids.repartitionByRange(shuffle_partitions(spark), "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    ends = dealt.groupBy("part").agg(F.min("doc_id").alias("low"), F.max(F.struct("doc_id", "quarter")).alias("high"))
    order = Window.orderBy("part")
    all_of = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = ends.select("part", F.coalesce(F.lead("low").over(order), F.first("low").over(all_of)).alias("after"), F.coalesce(F.lag("high").over(order), F.last("high").over(all_of)).alias("before"))
    own = Window.partitionBy("part").orderBy("doc_id")
    inner = dealt.select("part", "doc_id", F.lead("doc_id").over(own).alias("n"), F.lag(F.struct("doc_id", "quarter")).over(own).alias("p")).join(borders, "part")
    prev = F.coalesce("p", "before")
    return inner.select("doc_id", F.coalesce("n", "after").alias("next_id"), prev["doc_id"].alias("prev_id"), prev["quarter"].alias("prev_quarter"))


def _votes(d: DataFrame) -> DataFrame:
    """d: doc_id, th, text, next_id, head. Fingerprints of the text and of the edited text, whole rows of d grouped where they lie."""
    d = d.withColumn("n_chars", F.length("text").cast("long")).withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - quarter as int)), coalesce(substring(head, 1, quarter), ''))")
    d = d.select("doc_id", "th", "n_chars", "next_id", "text", edited.alias("edited"))
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    d = with_words(with_words(d, "text", "words"), "edited", "edited_words")
    tagged = lambda c, tag: F.struct(terms(c).alias("terms"), F.lit(tag).alias("tag"))
    key = ["doc_id", "th", "n_chars", "next_id", "edited_sha256", "tag"]
    d = d.select(*key[:-1], F.explode(F.array(tagged("words", 0), tagged("edited_words", 1))).alias("v"))
    d = d.select(*key[:-1], "v.tag", F.explode_outer("v.terms").alias("t")).select(*key, "t.h", "t.w")
    votes = d.groupBy(*key).agg(*vote_sums()).select(*key, fingerprint().alias("fp"))
    return votes.groupBy(*key[:-1]).agg(F.max(F.when(F.col("tag") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("tag") == 1, F.col("fp"))).alias("edited_fp"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp, next_id; edited: the last quarter of the text
    replaced by the beginning of the next document's.

    Whole texts are shuffled once, by id; of each text only what its neighbour takes moves a second time. Rows with
    null id are edited with nothing and have next_fp null; of several texts under the next id that with the smallest
    hash is taken. Equal rows stay as many as they are.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # Both uses of this join read one shuffle of the texts; the hint keeps them shuffled at any size, so figures grow evenly.
    near = keep(neighbours(docs), "neighbours").hint("merge")
    d = rows.filter("doc_id is not null").join(near, "doc_id")
    heads = d.select(F.col("prev_id").alias("doc_id"), F.struct("th", F.expr("substring(text, 1, prev_quarter)").alias("head")).alias("h"))
    heads = heads.groupBy("doc_id").agg(F.min("h")["head"].alias("head"))
    none = rows.filter("doc_id is null").withColumns({"next_id": F.lit(None).cast(docs.schema["doc_id"].dataType), "head": F.lit("")})
    both = keep(_votes(d.join(heads, "doc_id", "left")).unionByName(_votes(none)), "votes")
    nexts = both.groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by("fp", "th").alias("next_fp"))
    times = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).groupBy("doc_id", "th").agg(F.count("*").alias("times")).filter("times > 1")
    out = both.join(nexts, "next_id", "left").join(times.withColumnRenamed("doc_id", "i").withColumnRenamed("th", "t"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    return out.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp", "next_id")


def near_pairs(fps: DataFrame, radius: int = 3, spare: int = 3) -> DataFrame:
    """All pairs fp_a < fp_b of different fingerprints at most `radius` bits apart, with their distance.

    The bits are cut into radius + spare blocks. Near fingerprints agree on `spare` blocks at least, so each choice of that many blocks
    is a table whose key is those blocks moved to the front. Equal fingerprints are one before that, so copies make no pairs; a pair is
    given by the first table in which it meets, so none is shuffled twice. Nulls take no part.
    """
    n = radius + spare
    edge = [BITS * i // n for i in range(n + 1)]
    masks = []
    for chosen in combinations(range(n), spare):
        m = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in chosen)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    distinct = fps.select("fp").filter("fp is not null").distinct()
    tables = F.array(*(F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    t = distinct.select("fp", F.explode(tables).alias("t")).select("fp", "t.table", "t.key")
    a, b = t.withColumnRenamed("fp", "fp_a"), t.withColumnRenamed("fp", "fp_b")
    both = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F.coalesce(*(F.when(both.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))
    p = a.join(b, ["table", "key"]).filter((F.col("fp_a") < F.col("fp_b")) & (F.bit_count(both) <= radius) & (first == F.col("table")))
    return p.select("fp_a", "fp_b", F.bit_count(both).cast("int").alias("distance"))
