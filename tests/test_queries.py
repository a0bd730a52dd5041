import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tilewright import queries
from tilewright.functions import text
from tilewright.streaming.tiles import tile_counts

SF = "/root/testdata/sf0.001"


def rows(names, data):
    clean = lambda v: None if v is None else round(v, 9) + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = db.execute(queries.SQL[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall()) and got


@pytest.mark.parametrize("name", ["q_format_bytes", "q_format_count"])
def test_sizes_beyond_a_long(spark, tmp_path, name):
    """Keys of large tables, and none. In DuckDB the same SQL does not overflow on keys that are HUGEINT."""
    at = f"{tmp_path}/orders.parquet"
    keys = [None, -4, *range(8), *range(2147475, 2147490), *range(3036990, 3037010), *range(8999900, 9000000), 10**9, 10**10]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").coalesce(1).write.parquet(at)
    df = queries.QUERIES[name](spark, str(tmp_path))
    got = rows(df.columns, df.collect())
    cur = duckdb.connect().execute(f"create view orders as select o_orderkey::hugeint as o_orderkey from '{at}/*.parquet'").execute(queries.SQL[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall()) and len(got) == len(keys)


def test_bytes_are_rounded_by_their_exact_value(spark):
    want = {0: "0 B", 1023: "1023 B", 334080: "326.2 KiB", 334182: "326.3 KiB", 340223: "332.2 KiB", 1023 * 1024 + 1000: "1024.0 KiB", 2**63 - 1: "8388608.0 TiB"}
    near = [(2 * d + 1) * 2**40 // 20 + e for d in range(10**6, 10**6 + 50) for e in (0, 1)]
    want |= {n: f"{n / 2**40:.1f} TiB" for n in near}
    df = spark.createDataFrame([(n,) for n in want], "n bigint").select("n", text.bytes_text("n").alias("size"))
    assert {r.n: r.size for r in df.collect()} == want


def test_render(spark):
    t = queries.q_render_png(spark, SF)
    assert t.count() == 341 and t.select("kind").distinct().collect() == [(b"PNG".hex().upper(),)]


def test_stream(spark):
    p = queries.points(spark.read.parquet(f"{SF}/events.parquet"), "event_id").select("ts", "lon", "lat")
    want = tile_counts(p, 6).collect()
    with tempfile.TemporaryDirectory() as d:
        p.write.parquet(f"{d}/in")
        s = spark.readStream.schema(p.schema).parquet(f"{d}/in")
        q = tile_counts(s, 6).writeStream.format("memory").queryName("tiles").outputMode("complete").option("checkpointLocation", f"{d}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(spark.table("tiles").collect()) == sorted(want) and spark.table("tiles").agg(F.sum("points")).first()[0] == p.count()
