"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and foreign columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tilewright.llm import fingerprints, mixing, near_dup, nearest, packing, quality, suffix_dedup, token_counts, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, m int, th long, rank int, size string"


def words(r, n):
    return " ".join("".join(r.choice(["the", "on", "ti", "re", "é", "wh"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [words(r, r.randrange(40, 120)) for _ in range(12)]
    out = []
    for i in range(70):
        t = r.choice(base).split(" ")
        for _ in range(r.randrange(0, 14)):
            t[r.randrange(len(t))] = words(r, 1)
        out.append((i, " ".join(t)))
    out += [(100 + i, base[0]) for i in range(9)]  # copies
    out += [(200, None), (201, ""), (202, "a"), (203, "A b"), (204, "  \n\t "), (205, words(r, 9000)), (206, "x" * 30_000), (207, base[1] + "\n" + base[2]), (208, "ΑΣ <s> ▁ 你好 \u0000 <|endoftext|>.")]
    out += [(209, base[3]), (209, base[3])]  # a row twice
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, None, [None, "a", "b", "b", "b"][i % 5], None, "k", 1, 2, 3, "s") for i, t in rows]
    return spark.createDataFrame(data, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def with_null_id(spark, docs):
    return docs.unionByName(spark.createDataFrame([(None, "no id here", None, None, None, None, None, None, None, None)], DOCS))


def component_of(rows, size, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("size", "percent", "groups", "hashes"), [(3, 85, 12, 3), (5, 80, 12, 3), (2, 60, 30, 2)])
def test_near_duplicates(docs, rows, size, percent, groups, hashes):
    got = near_dup.near_duplicates(docs, size, percent, groups, hashes).collect()
    want = component_of(rows, size, percent)
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_block_search():
    r = np.random.default_rng(0)
    u, v = ([np.unique(r.integers(0, 300, 80).astype(np.uint64)) for _ in range(k)] for k in (7, 9))
    assert (near_dup.intersections(u, v, 64) == [[len(set(a) & set(b)) for b in v] for a in u]).all()


def test_near_duplicates_stated_misses():
    for s in (0.85, 0.8):
        miss = 1 - (1 - (1 - s**3) ** 12) ** 2
        assert f"{miss:.1e}".replace("e-0", "e-") + f" at {s}" in near_dup.__doc__


def test_near_duplicates_edges(with_null_id, empty):
    got = [r for r in near_dup.near_duplicates(with_null_id).collect() if r.doc_id is None]
    assert got[0].component_id is None and got[0].kept
    assert near_dup.near_duplicates(empty).count() == 0


def removed(rows, length):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k] += 1
                gone[k + length] -= 1
        c = np.cumsum(gone)[:-1] > 0
        spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
        out.append((i, len(b), int(c.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, rows):
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs, 50, digest=True).collect())) == removed(rows, 50)


def test_suffix_dedup_small_frontier(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FRONTIER", 900)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs, 50, digest=True).collect())) == removed(rows, 50)


def test_suffix_dedup_texts(with_null_id, docs, empty):
    got = suffix_dedup.remove_repeats(with_null_id, 50)
    assert got.columns == with_null_id.columns and got.count() == with_null_id.count()
    assert [r.text for r in got.filter("doc_id is null").collect()] == ["no id here"] and got.filter("doc_id = 200").first().text is None
    assert got.filter("doc_id >= 101 and doc_id <= 108 and length(text) > 0").count() == 0
    assert suffix_dedup.remove_repeats(empty, 50, digest=True).count() == 0


def test_token_counts(docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(map(tuple, token_counts.count_tokens(docs).collect()))
    assert got == sorted((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    assert token_counts.count_tokens(empty).count() == 0


def test_null_ids(with_null_id):
    assert [tuple(r) for r in token_counts.count_tokens(with_null_id).filter("doc_id is null").collect()] == [(None, 10, len(token_counts.transducer("piece_bpe_32k.model").model.encode("no id here")))]
    assert mixing.mix(with_null_id).filter("doc_id is null and size = 3").count() == 1
    assert packing.pack(with_null_id).filter("doc_id is null").agg(F.sum("length"), F.max("doc_tokens")).first() == (4, 4)


def test_token_counts_of_pieces(monkeypatch):
    """Texts of which every border is one of pieces; tables so small that they are thrown away again and again."""
    t, r = token_counts.transducer("piece_bpe_32k.model"), random.Random(4)
    assert t.compiles
    for limit in (300_000, 30):
        monkeypatch.setattr(token_counts, "TRANSITIONS", limit)
        t.forget()
        for _ in range(1500):
            s = "".join(r.choice(t.pieces) for _ in range(r.randrange(12))) + " " * r.randrange(40) + "".join(r.choice("etaoin shrdlu") for _ in range(30))
            assert t.count(s) == len(t.model.encode(s)), s
    t.forget()


def test_token_counts_in_chunks(monkeypatch):
    t, r = token_counts.transducer("piece_bpe_32k.model"), random.Random(1)
    for chunk in (3, 7, 50):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        for _ in range(1500):
            s = "".join(r.choice("ab  \n▁éthe你😀<s>.%") for _ in range(r.randrange(90)))
            assert t.count(s) == len(t.model.encode(s)), s


def test_mixing(docs, rows, empty, spark):
    q = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "doc_id long, weight double")
    a, b = (sorted(mixing.mix(d, q).collect(), key=repr) for d in (docs, docs.repartition(3)))
    assert a == b and len(a) == len(rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in a:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r["size"] and r.copies <= 2
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    largest = max(r["size"] for r in a)
    assert all(target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= largest for s in sizes)
    assert mixing.mix(empty).count() == 0
    copies = collections.Counter()
    for r in a:
        copies[r.doc_id] = max(copies[r.doc_id], r.copies)
    got = collections.Counter(r.doc_id for r in mixing.resample(docs, q).collect())
    assert all(got[i] == copies[i] * (2 if i == 209 else 1) for i in copies)


def test_mixing_any_weights(spark, monkeypatch):
    """Equal weights choose alike whatever they are, and leave the buckets even."""
    monkeypatch.setattr(mixing, "BUCKET", 100)
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b").alias("text"))
    one = {r.doc_id: r.copies for r in mixing.mix(d, share=0.5).collect()}
    for w in (1000.0, 1e-6, float("inf"), float("nan")):
        assert {r.doc_id: r.copies for r in mixing.mix(d, d.select("doc_id", F.lit(w).alias("weight")), share=0.5).collect()} == one
    assert sum(one.values()) == 1500


def test_mixing_targets(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 30), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    w, size = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 10, "b": 1000, "c": 30, None: 500, "d": 0}
    want, left, todo = {}, 1.5 * 1540, dict(w)
    while True:  # share by weight, stop those above, share again
        over = [k for k in todo if left * w[k] / sum(todo.values()) > 2 * size[k]]
        if not over:
            break
        for k in over:
            want[k] = 2.0 * size[k]
        left -= sum(want[k] for k in over)
        todo = {k: v for k, v in todo.items() if k not in over}
    want |= {k: left * v / sum(todo.values()) for k, v in todo.items()}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for window in (64, 2048):
        got = packing.pack(docs, window=window).collect()
        covered, by = collections.Counter(), collections.defaultdict(list)
        for p in got:
            piece = ids[p.doc_id][p.start : p.start + p.length]
            assert len(piece) == p.length and p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(np.array(piece, "<u4").tobytes()) == p.ids_crc32
            covered.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
            by[p.sequence_id].append((p.offset, p.length))
        assert covered == collections.Counter((i, k) for i, _ in rows for k in range(len(ids[i])))
        for s in by.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at == window or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_packing_greedy():
    r = np.random.default_rng(0)
    for _ in range(200):
        left = r.integers(0, 3, 64) * (r.random(64) < 0.3)
        left[0] = 0
        for first in np.flatnonzero(left):
            c = packing.filling(left, int(first), 64)
            if c:
                assert sum(c) == 64 and c[0] == first and all(left[m] >= c.count(m) for m in c)
    assert packing.filling(np.array([0, 1, 0, 1]), 3, 4) == (3, 1) and packing.filling(np.array([0, 0, 1, 0]), 2, 4) is None


def test_word_ids():
    w, r = packing.word_ids("word_bpe_49k.json"), random.Random(2)
    for _ in range(4000):
        s = "".join(r.choice("aB.,'!ΣİéÉ é \n\t9%<|ſßﬁ  x-\"#") for _ in range(r.randrange(14))) + r.choice(["", "<|endoftext|>.", "don't"])
        assert np.frombuffer(w([s])[0], "<u2").tolist() == w.tokenizer.encode(s, add_special_tokens=False).ids, s


def test_fingerprints(docs, rows, with_null_id, empty):
    order = sorted({i: t or "" for i, t in rows}.items())
    nexts = {a[0]: b for a, b in zip(order, order[1:] + order[:1])}
    fp = {}
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t, q = dict(order)[r.doc_id], len(dict(order)[r.doc_id]) // 4
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - q] + nexts[r.doc_id][1][:q]).encode()).hexdigest()
        assert fp.setdefault(t, r.fp) == r.fp
    assert all(r.next_fp == fp[nexts[r.doc_id][1]] for r in got)
    assert {r.doc_id: r.fp for r in fingerprints.fingerprints(docs).collect()} == {r.doc_id: r.fp for r in got}
    assert fingerprints.edited_fingerprints(with_null_id).filter("doc_id is null and next_fp is null").count() == 1
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_fingerprint_bits(spark):
    import re

    import xxhash

    def brute(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        votes, total = [0] * 64, 0
        for x, y in zip(words, [*words[1:], None], strict=False):
            h = xxhash.xxh64_intdigest(x.encode(), 42)
            h = h if y is None else xxhash.xxh64_intdigest(y.encode(), h)
            w = min(16, len(x) + len(y or ""))
            total += w
            for j in range(64):
                votes[j] += w * (h >> j & 1)
        return sum(1 << j for j in range(64) if 2 * votes[j] > total)

    r = random.Random(6)
    texts = {i: t for i, t in enumerate([words(r, 30), words(r, 200), "", None, "one", "a b  a\nb", words(r, 31)])}
    got = {x.doc_id: x for x in fingerprints.edited_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).withColumn("near", fingerprints.likeness(F.col("fp"), F.col("edited_fp"))).withColumn("next", fingerprints.likeness(F.col("fp"), F.col("next_fp"))).collect()}
    for i, t in texts.items():
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        fp, edited, follows = brute(t), brute(t[: len(t) - q] + after[:q]), brute(after)
        assert (got[i].fp % 2**64, got[i].edited_fp % 2**64, got[i].next_fp % 2**64) == (fp, edited, follows)
        assert got[i].near == 1 - bin(fp ^ edited).count("1") / 64 and got[i].next == 1 - bin(fp ^ follows).count("1") / 64


def test_near_pairs(spark):
    r = random.Random(1)
    v = [r.getrandbits(64) for _ in range(60)]
    v += [x ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for x in v for _ in range(3)]
    v = [x - (1 << 64) if x >> 63 else x for x in v]
    want = {(a, b) for a in v for b in v if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    got = fingerprints.near_pairs(spark.createDataFrame([(x,) for x in [*v, *v, None]], "fp long"), 3).collect()
    assert {(x.fp_a, x.fp_b) for x in got} == want and len(got) == len(want)
    assert fingerprints.near_pairs(spark.createDataFrame([], "fp long")).count() == 0


def test_nearest(spark, monkeypatch):
    r = np.random.default_rng(0)
    x = r.normal(size=(900, 16))
    data = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(900)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [1.0] * 3), (1100, [float("inf")] * 16)]
    monkeypatch.setattr(nearest, "CANDIDATES", 256)
    monkeypatch.setattr(nearest, "QUERIES", 20)
    got = collections.defaultdict(dict)
    for a in nearest.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), 20, 20, rerank=64).collect():
        got[a.query_id][a.rank] = (a.vec_id, a.score)
    x = x.astype(np.float32).astype(float)
    hits = 0
    for i in range(0, 900, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len({v for v, _ in got[i].values()} & set(np.argsort(-s)[:20].tolist()))
        assert sorted(got[i]) == list(range(1, 21)) and all(abs(s[v] - sc) < 1e-9 for v, sc in got[i].values())
    assert set(got) == set(range(0, 900, 20)) and hits >= 0.9 * 20 * 45
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20).count() == 0
    few = nearest.search(spark.createDataFrame(data[:5], "vec_id long, embedding array<float>"), 2).collect()
    assert len(few) == 3 * 4


@pytest.mark.parametrize("spread", [0.0, 0.05])
def test_nearest_third_of_the_rows_alike(spark, monkeypatch, spread):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16))
    x[r.permutation(1500)[:500]] = r.normal(size=16) + spread * r.normal(size=(500, 16))
    x = x.astype(np.float32).astype(float)
    monkeypatch.setattr(nearest, "CANDIDATES", 800)
    got = collections.defaultdict(dict)
    for a in nearest.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), 20, 20, rerank=32).collect():
        got[a.query_id][a.rank] = a.vec_id
    for i in range(0, 1500, 20):
        s = np.einsum("nd,d->n", x, x[i])
        s[i] = -np.inf
        assert [got[i][n] for n in range(1, 21)] == np.lexsort((np.arange(1500), -s))[:20].tolist()


def test_nearest_first_of_equal():
    x = np.ones((8, 4))
    assert nearest.first_of_equal(x, 2).tolist() == [0, 1, 2]
    x[4] = 2
    assert nearest.first_of_equal(x, 2).tolist() == [0, 1, 2, 4]


def test_nearest_repeated_ids(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(101, 8)), 3)
    ids = [*range(100), 0]
    v = spark.createDataFrame([(i, y.tolist(), 5) for i, y in zip(ids, x, strict=True)] + [(None, [1.0] * 8, 5)], "vec_id long, embedding array<double>, rank int")
    lists = collections.defaultdict(list)
    for a in nearest.search(v, 20, 20).collect():
        lists[a.query_row].append((a.rank, a.query_id, a.vec_id, a.score))
    want = []
    for i in [j for j, k in enumerate(ids) if k % 20 == 0]:
        s = sorted((-float(np.cumsum(x[i] * x[j])[-1]), ids[j]) for j in range(101) if j != i)[:20]
        want.append([(n, ids[i], k, -t) for n, (t, k) in enumerate(s, 1)])
    assert sorted(map(sorted, lists.values())) == sorted(want)


def archived(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    manifest = spark.createDataFrame(warc.write_archives(warc.judged(pages), folder).collect(), "archive string, records long, n_bytes long")
    return warc.open_archives(manifest, folder), manifest


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    big = "é" * 40_000
    data = [(1, "http://a/\r\nX: y", big), (2, None, big), (0, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "w", "z" * 100), (7, "w", "z" * 100), (None, "n", "no id")]
    pages = spark.createDataFrame([(*d, 1, "x") for d in data], "page_id long, url string, html string, digest int, refers_to string")
    archives, manifest = archived(spark, pages, tmp_path)
    (tmp_path / "w" / "part-000000-left-over.warc.gz").write_bytes(b"of a lost task")
    got = warc.assemble(warc.read_records(archives)).collect()
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == manifest.count() + 1 > 2
    assert collections.Counter((r.page_id, r.response.record_type) for r in got) == collections.Counter((i, "revisit" if i in (1, 2) else "response") for i, _, _ in data)
    for r in got:
        html = (dict((i, h) for i, _, h in data)[r.page_id] or "").encode()
        assert r.response.payload_bytes == len(html) and r.response.payload_digest == hashlib.sha256(html).hexdigest() and r.request and r.metadata
        assert r.response.payload is None if r.response.record_type == "revisit" else bytes(r.response.payload) == html
        assert (r.response.refers_to_page == 0) == (r.page_id in (1, 2))
    (tmp_path / "none").mkdir()
    assert warc.assemble(warc.read_records(archived(spark, pages.limit(0), tmp_path / "none")[0])).count() == 0


def test_warc_of_others(spark):
    http = lambda fields, body: b"HTTP/1.1 200 OK\r\n" + fields + b"\r\n" + body
    of = lambda name, block: warc.record("response", [("WARC-Record-ID", name)], block)
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: plain\r\nContent-Length: 4\r\n\r\nA\r\n\r\r\n\r\n" * 2
    good = of("fits", http(b"Content-Length: 3\r\n", b"abc")) + of("untold", http(b"Server: x\r\n", b"abc")) + of("longer", http(b"content-length: 9\r\n", b"abc"))
    good += of("chunks", http(b"Transfer-Encoding: chunked\r\n", b"2;x\r\nab\r\n1\r\nc\r\n0\r\n\r\n")) + of("broken chunks", http(b"Transfer-Encoding: chunked\r\n", b"zz\r\nab"))
    good += warc.record("response", [("WARC-Record-ID", "digest"), ("WARC-Payload-Digest", "sha256:00")], http(b"", b"abc"))
    rows = [("a", good), ("cut", of("cut", http(b"", b"abc" * 99))[:-20]), ("none", b"no record\r\n\r\n"), ("plain", plain), ("null", None), ("empty", b""), ("garbage", b"\x1f\x8bnot gzip")]
    got = [(r.record_id, r.record_type, r.damaged, r.payload and bytes(r.payload)) for r in warc.read_records(spark.createDataFrame(rows, "archive string, content binary").coalesce(1)).collect()]
    assert got[:6] == [("fits", "response", False, b"abc"), ("untold", "response", False, b"abc"), ("longer", "response", True, b"abc"), ("chunks", "response", False, b"abc"), ("broken chunks", "response", True, b"zz\r\nab"), ("digest", "response", True, b"abc")]
    assert [g[:3] for g in got[6:]] == [("cut", "response", True), (None, None, True), ("plain", "response", False), ("plain", "response", False)]


def test_url_rules(spark):
    cases = {
        "http://Example.com/en/7x?q": ("example.com", "/en/7x", "example.com/en/7", "allow"), "https://a.example.com/en/8": ("a.example.com", "/en/8", "com/en/", "block"), "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://telecom/en/": ("telecom", "/en/", None, "allow"), "x://b.net/de/8": ("b.net", "/de/8", "net/de/", "block"), "x://example.net/de/8#": ("example.net", "/de/8", "example.net/de/8", "allow"), "http://a.org": ("a.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "http://a.org?x/es/": ("a.org", "", None, "allow"), "": ("", "", None, "allow"), "q?u=http://c.org/es/1": ("c.org", "/es/1", "org/es/", "block"),
    }
    data = [(i, u, None) for i, u in enumerate(cases)] + [(99, None, None)]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(spark.createDataFrame(data, "page_id long, url string, html string"), majority=1.0).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == ("", "", None, "allow")


def test_links_spread_trust(spark):
    hub = "".join(f'<a href="http://bad{i}.com/en/1">' for i in range(3)) + "<a href='/x'>"
    data = [(i, f"http://bad{i % 3}.com/en/{i}", None) for i in range(6)] + [(10, "http://farm.xyz/a", hub), (11, "http://good.example.com/en/7", '<A HREF="//fine.xyz/p">'), (12, "http://fine.xyz/p", None)]
    got = {r.host: r for r in url_filter.host_scores(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got["farm.xyz"].blocked and got["bad0.com"].blocked and not got["fine.xyz"].blocked and got["fine.xyz"].trust > 0


def test_links_do_not_dilute_distrust(spark):
    links = [("x", "a"), ("a", "bad.com")]  # a chain
    links += [(f"c{i + 1}", f"c{i}") for i in range(17)] + [("c0", "deep.com")]  # a long one
    links += [("u", "loop.com"), ("v", "u"), ("u", "v")]  # a cycle
    links += [(f"one{i}", "many.com") for i in range(20)] + [("single", "few.com")]  # linkers
    links += [("good.example.com", "fine"), ("fine", "next"), ("next", "fine"), ("fine", "few.com")]
    seeds = ["bad.com", "deep.com", "loop.com", "many.com", "few.com", "alone.com"]
    data = [(f"http://{a}/p", f"<a href='http://{b}/'>") for a, b in links] + [("http://good.example.com/en/7", None)] + [(f"http://{h}/en/{i}", None) for h in seeds for i in range(2)] + [(f"http://{h}/free", None) for h in seeds]
    pages = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "page_id long, url string, html string")
    blocked = {r.host for r in url_filter.host_scores(pages).collect() if r.blocked}
    assert blocked == {*seeds, *(a for a, _ in links)} - {"good.example.com", "fine", "next"}
    assert {r.verdict for r in url_filter.judge(pages).collect() if r.path == "/free"} == {"block"}


def test_links_against_other_routes(spark, tmp_path):
    """A random web: scores as the solution of the linear equations, verdicts by the SQL."""
    import duckdb

    r = random.Random(8)
    hosts = [f"h{i}.{r.choice(['com', 'net', 'org', 'xyz'])}" for i in range(40)] + ["example.com", "www.example.net"]
    data = []
    for i in range(400):
        h = r.choice(hosts)
        path = r.choice(["/en/7", "/de/8", "/es/1", "/x", ""])
        links = "".join(f'<a HREF = "{r.choice(["http:", "https:", ""])}//{r.choice(hosts).upper()}/p">' for _ in range(r.randrange(3)))
        data.append((i, f"http://{h}{path}", r.choice([links, links, None]), "rule", 1))
    hosts += ["far.xyz", "bad.com"]
    data += [(501, "http://far.xyz/x", '<a href="//bad.com/">', None, 1), (502, "http://bad.com/en/1", None, None, 1)]
    data += [data[0], (None, None, None, None, 2), (500, "http://h1.com/en/1", "", None, 3)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, rule string, verdict int")
    got = {x.host: x for x in url_filter.host_scores(pages).collect()}
    edges = {(x.src, x.dst): x.links for x in url_filter.host_edges(pages).collect()}
    assert edges == collections.Counter((d[1].split("/")[2], x) for d in data if d[1] and d[2] for x in [y.split("//")[1].split("/")[0].lower() for y in d[2].split("<a")[1:]] if x != d[1].split("/")[2])
    verdicts = collections.defaultdict(collections.Counter)
    for x in url_filter.with_rules(pages.drop("rule").select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))).collect():
        verdicts[x.host][x.ruled] += 1
    block = {h for h, c in verdicts.items() if h and c["block"] > sum(c.values()) / 2}
    allow = {h for h, c in verdicts.items() if h and c["allow"]} - block
    assert block and allow
    for seeds, col, turn in ((allow, "trust", False), (block, "distrust", True)):
        n = len(hosts)
        p = np.zeros((n, n))
        for (a, b), k in edges.items():
            a, b = (b, a) if turn else (a, b)
            p[hosts.index(a), hosts.index(b)] = k
        p /= np.maximum(p.sum(1, keepdims=True), 1)
        s = np.linalg.solve(np.eye(n) - 0.85 * p.T, np.array([float(h in seeds) for h in hosts]))
        assert all(abs((got[h][col] if h in got else 0.0) - s[i]) <= 0.02 * s.sum() for i, h in enumerate(hosts))
    con = duckdb.connect()
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.execute(url_filter.sql()).fetchall()
    key = lambda x: tuple(map(str, x))
    judged = sorted(map(tuple, url_filter.judge(pages).collect()), key=key)
    assert judged == sorted(want, key=key) and len(judged) == len(data)
    assert len({x[4] for x in judged if x[3] is None}) == 2
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_quality_tables(spark):
    """A score is the sum of the tables' entries, looked up one by one; clashing names are no matter."""
    r = random.Random(9)
    texts = [words(r, r.randrange(1, 60)) + r.choice(["", "!!", " ###", " 123"]) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 0.5, 7, "n") for i, t in enumerate(texts)], "doc_id long, text string, score double, y int, labelled string")
    labels = spark.createDataFrame([(i, int(len(t) % 3 > 0), "k") for i, t in enumerate(texts)], "doc_id long, quality int, text string")
    m = quality.train(docs, labels)
    assert m.pairs
    for x in quality.score(docs, m).collect():
        v, z = quality.features(texts[x.doc_id]), m.base
        for j, t in enumerate(m.tables):
            z += t[sum(e <= v[j] for e in m.edges[j])]
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            z += t[sum(e <= v[i] for e in m.coarse[i])][sum(e <= v[j] for e in m.coarse[j])]
        assert abs(x.score - 1 / (1 + np.exp(-z))) < 1e-9
    assert quality.select_good(docs, m, 0.0).columns == docs.columns


def test_quality(spark):
    r = random.Random(3)
    good = lambda: words(r, r.randrange(5, 80))
    bad = lambda: " ".join(w + r.choice(["***", "###"]) for w in words(r, 40).split())
    data = [(i, good() if i % 4 else bad()) for i in range(900)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0) if i != 7 else None, 0) for i in range(900)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(7), labels)
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    assert got == {x.doc_id: x.score for x in quality.score(docs, again).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 4 > 0) for i in held) >= 0.95 * len(held) and len(got) == 902
    assert all(0 <= s <= 1 for s in got.values())
    kept = {x.doc_id for x in quality.select_good(docs, model, 0.3).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.3}
    none = quality.train(docs, labels.limit(0))
    assert {x.score for x in quality.score(docs, none).collect()} == {0.5} and quality.score(docs.limit(0), model).count() == 0
