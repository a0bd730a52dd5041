"""Removal of long byte strings that a document shares with an earlier one.

1. Texts that an earlier document has as a whole are settled by their hash, and take no further part.
2. Candidates. A string of `length` bytes holds length - K + 1 runs of K bytes; the one with the smallest hash, the leftmost
   of several, is its anchor. Equal strings have equal anchors at the same place. Texts are dealt into batches; each batch sends the
   hashes of its anchors, once each, to the range of hashes they fall in, and gets back those that several documents have.
3. Neighbouring strings with one anchor that is shared are written as one segment. Equal segments become one, with the smallest document
   that has it, before anything meets in one place.
4. Segments with the same anchor meet in a bin. The suffixes that begin at anchors are
   sorted, and one frontier of intervals grows breadth first with the length of their common prefix. From one value to the next each interval is
   extended backward, the step of a Burrows-Wheeler transform (a stable sort by the byte before), and the intervals of suffixes that agree in
   so many bytes from the anchor on come in; the strings that begin j bytes before the anchor are those which come in at length - j. All
   stop at `length`: an interval's strings are then equal, and its smallest document is the earliest. Intervals of one row are dropped as they
   arise. A transform of the whole corpus is never needed: strings with different anchors are never equal.
5. Each segment's documents learn where an earlier one has the string, and the covered bytes go.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep

K = 20
#: Bytes of text in a batch, of anchor hashes in a range, of segments in a bin, about.
BATCH, RANGE, BIN = 3 << 20, 24 << 20, 4 << 20
#: Rows of a frontier of intervals, about; where a bin has more, fewer of them are extended at a time.
FRONTIER = 2_500_000
#: Bytes of texts hashed at a time.
PART = 1 << 19
#: Low bits of a sliding minimum that hold the place; a batch of texts, or one text, may have so many bytes.
PLACE = np.uint64((1 << 30) - 1)
LOW = np.uint64((1 << 40) - 1)
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULT[0]
    return h ^ (h >> np.uint64(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    m, w = h, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - w : len(h) - w + 1]) if w < width else m


def anchor_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one anchor: its hash, the text's number, start, number of strings, bytes before the anchor.
    Some texts at a time, as the arrays are many times their size."""
    out, first, used = [], 0, 0
    for i, t in enumerate(texts, 1):
        used += len(t)
        if used >= PART or i == len(texts):
            v, doc, *rest = _runs_of(texts[first:i], length)
            out.append((v, doc + first, *rest))
            first, used = i, 0
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _runs_of([], length)


def _runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, none, none
    if len(raw) > int(PLACE):
        raise ValueError("a text of more than 1 GiB")
    h1 = _TABLE[raw]
    h2 = h1[:-1] * _MULT[0] + h1[1:]
    h4 = h2[:-2] * _MULT[1] + h2[2:]
    h8 = h4[:-4] * _MULT[2] + h4[4:]
    h16 = h8[:-8] * _MULT[3] + h8[8:]
    h = mix(h16[:-4] * _MULT[4] + h4[16:])
    least = sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - K + 1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    cut = np.zeros(len(least) + 1, bool)  # where a run begins or strings run over a text's end
    whole = np.ones(len(least), bool)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        cut[min(s, len(least))] = True
        whole[max(s, e - length + 1) : e] = False
    cut[1:-1] |= least[1:] != least[:-1]
    cut[:-1] |= np.concatenate([[True], whole[1:] != whole[:-1]])
    cut[-1] = True
    at = np.flatnonzero(cut)
    first, n = at[:-1], np.diff(at)
    good = whole[first]
    first, n = first[good], n[good]
    anchor = (least[first] & PLACE).astype(np.int64)
    doc = np.searchsorted(ends, first, side="right")
    return mix(h[anchor] ^ _MULT[1]), doc, first - starts[doc], n, anchor - first


def pack(v: np.ndarray) -> bytes:
    """The low 40 bits of each hash."""
    return np.ascontiguousarray((v & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(b) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def range_of(v: np.ndarray, ranges: int) -> np.ndarray:
    return ((v >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)


def earliest(segments: list[bytes], before: np.ndarray, docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment and each string of `length` bytes in it the smallest document of any segment that has the string at the same
    place of its anchor. before: bytes of a segment before its anchor."""
    n, wide = len(segments), length - K
    sizes = np.array([len(s) for s in segments], np.int64)
    right = sizes - before
    flat = np.frombuffer(b"".join(segments) + bytes(length), np.uint8)
    begin = np.cumsum(sizes) - sizes
    cols = np.arange(length)
    after = np.where(cols < right[:, None], flat[np.minimum((begin + before)[:, None] + cols, len(flat) - 1)], 0).astype(np.uint8)
    ahead = np.where(cols[:wide] < before[:, None], flat[np.maximum((begin + before - 1)[:, None] - cols[:wide], 0)], 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(after).view(f"S{length}").ravel(), kind="stable").astype(np.int32)
    differ = after[order][1:] != after[order][:-1]
    prefix = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), length)])  # common with the row before
    out = np.repeat(docs[:, None], wide + 1, 1)
    room = sizes - length
    some = max(1, FRONTIER // max(1, n))  # reaches to the right that share a frontier
    for low in range(K, length + 1, some):
        rows, reach, interval = np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(0, np.int32)
        for value in range(low, length + 1):
            if len(rows):  # each interval by the byte ahead of it
                byte = ahead[rows, value - 1 - reach]
                by = np.argsort(byte, kind="stable")
                rows, reach, interval, byte = rows[by], reach[by], interval[by], byte[by]
                rows, reach, interval = several(rows, reach, interval, (interval[1:] != interval[:-1]) | (byte[1:] != byte[:-1]))
            if value < low + some:  # and those of strings that begin length - value bytes before the anchor come in
                j = length - value
                has = (before[order] >= j) & (right[order] >= value) & (before[order] - j <= room[order])
                at = np.cumsum(prefix < value, dtype=np.int32)[has]
                more = several(order[has], np.full(len(at), value, np.int8), at, at[1:] != at[:-1])
                rows, reach, interval = np.concatenate([rows, more[0]]), np.concatenate([reach, more[1]]), np.concatenate([interval, more[2] + len(rows) + 1])
        if len(rows):
            first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
            out[rows, length - reach.astype(np.int64)] = np.repeat(np.minimum.reduceat(docs[rows], first), np.diff(np.concatenate([first, [len(rows)]])))
    return [out[i, b - k : b + 1][::-1] for i, (b, k) in enumerate(zip(before.tolist(), room.tolist(), strict=True))]


def several(rows: np.ndarray, reach: np.ndarray, interval: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, ...]:
    """Without the rows that are an interval alone; intervals numbered anew. border: where an interval ends."""
    new = np.concatenate([[True], border, [True]])[: len(rows) + 1] if len(rows) else np.zeros(1, bool)
    keep_ = ~(new[:-1] & new[1:])
    return rows[keep_], reach[keep_], np.cumsum(new[:-1], dtype=np.int32)[keep_]


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], np.concatenate([reach[first[1:] - 1], reach[-1:]])], 1)


def batches_of(docs: DataFrame, columns: list[str], count: int) -> DataFrame:
    """Rows dealt by id into `count` batches, each whole in one place."""
    id_ = F.col("doc_id").cast("long")
    return docs.select(F.pmod(F.xxhash64(id_), F.lit(count)).alias("__batch"), id_.alias("__id"), F.xxhash64("text").alias("__th"), *columns).repartition(count, "__batch")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, th, size of the documents whose text a document with a smaller id has. Only hashes and ids move."""
    id_ = F.col("doc_id").cast("long")
    d = docs.filter("doc_id is not null").select(id_.alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return d.join(first, "sha").filter("doc_id > first").select("doc_id", "th", "size").distinct()


def segments(docs: DataFrame, settled: DataFrame, length: int, count: int, ranges: int) -> DataFrame:
    """v, seg, before, doc_id, th, start: the segments of all runs whose anchor several documents have. settled: documents left out."""
    t = batches_of(docs.filter("doc_id is not null"), ["text"], count)
    out_of = settled.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).alias("__batch"), F.lit(-1).cast("long").alias("range"), F.concat(F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), F.unhex(F.lpad(F.hex("th"), 16, "0"))).alias("hashes"))

    def read(table, right):
        """Texts and rows of the table, those left out as empty ones; the rows of right that are hashes."""
        out = {bytes(x) for r, x in zip(right.column("range").to_pylist(), right.column("hashes").to_pylist(), strict=True) if r < 0}
        ids, ths = table.column("__id").to_numpy(), table.column("__th").to_numpy()
        keys = np.stack([ids, ths], 1).astype(">i8").tobytes()
        return [b"" if keys[16 * i : 16 * i + 16] in out else (x or "").encode("utf-8", "surrogatepass") for i, x in enumerate(table.column("text").to_pylist())], ids, ths

    def send(table: pa.Table, right: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"range": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary()), "several": pa.array([], pa.binary())})
        texts, ids, _ = read(table, right)
        v, doc, *_ = anchor_runs(texts, length)
        order = np.lexsort((ids[doc], v))
        v, d = v[order], ids[doc][order]
        new = np.concatenate([[True], v[1:] != v[:-1]])[: len(v)]
        first = np.flatnonzero(new)
        several = d[first] != d[np.concatenate([first[1:], [len(v)]]) - 1] if len(first) else np.zeros(0, bool)
        v = v[first]
        cuts = np.searchsorted(range_of(v, ranges), np.arange(ranges + 1))
        rows = [(r, pack(v[a:b]), pack(v[a:b][several[a:b]])) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
        batch = table.column("__batch")[0].as_py()
        return pa.table({"range": pa.array([r for r, _, _ in rows], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()), "hashes": pa.array([x for _, x, _ in rows], pa.binary()), "several": pa.array([x for _, _, x in rows], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("hashes").to_pylist()]
        more = np.unique(np.concatenate([unpack(x) for x in table.column("several").to_pylist()]))
        every = np.sort(np.concatenate(parts))
        many = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], more]))
        out = []
        for b, p in zip(table.column("batch").to_pylist(), parts, strict=True):
            hit = p[np.isin(p, many, assume_unique=True)]
            if len(hit):
                out.append((b, pack(hit)))
        r = table.column("range")[0].as_py()
        return pa.table({"__batch": pa.array([b for b, _ in out], pa.int64()), "range": pa.array([r] * len(out), pa.int64()), "hashes": pa.array([x for _, x in out], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"v": [], "seg": [], "before": [], "doc_id": [], "th": [], "start": []}
        hashes = [(r, h) for r, h in zip(right.column("range").to_pylist(), right.column("hashes").to_pylist(), strict=True) if r >= 0]
        if len(left) and hashes:
            texts, ids, ths = read(left, right)
            known = np.concatenate([range_bits(r, unpack(h)) for r, h in hashes])
            known.sort()
            v, doc, start, n, before = anchor_runs(texts, length)
            mine = range_bits(range_of(v, ranges), v & LOW)
            hit = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
            v, doc, start, n, before = v[hit], doc[hit], start[hit], n[hit], before[hit]
            out = {
                "v": v.view(np.int64), "seg": [texts[d][s : s + m + length - 1] for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)],
                "before": before, "doc_id": ids[doc], "th": ths[doc], "start": start,
            }
        return pa.table({k: pa.array(x, pa.binary() if k == "seg" else pa.int64()) for k, x in out.items()})

    def range_bits(r, low):
        return (np.asarray(r).astype(np.uint64) << np.uint64(40)) | low

    sent = t.groupBy("__batch").cogroup(out_of.groupBy("__batch")).applyInArrow(send, "range long, batch long, hashes binary, several binary")
    shared = sent.repartition(ranges, "range").groupBy("range").applyInArrow(compare, "__batch long, range long, hashes binary")
    return t.groupBy("__batch").cogroup(shared.unionByName(out_of).groupBy("__batch")).applyInArrow(cut, "v long, seg binary, before long, doc_id long, th long, start long")


def removals(docs: DataFrame, length: int) -> tuple[DataFrame, int]:
    """doc_id, th (hash of the text), first, last: spans to remove; and the number of batches texts are dealt into."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, ranges = max(1, math.ceil(size / BATCH)), max(1, math.ceil(size * 0.4 / RANGE))
    settled = keep(copies(docs), "copies")
    found = keep(segments(docs, settled, length, count, ranges), "segments")
    bins = max(1, math.ceil(found.agg(F.sum(F.length("seg"))).first()[0] or 0) // BIN + 1)

    def combine(table: pa.Table) -> pa.Table:
        t = table.group_by([c for c in table.column_names if c not in ("low", "high")]).aggregate([("low", "min"), ("high", "max")])
        return t.rename_columns([c.removesuffix("_min").removesuffix("_max") for c in t.column_names])

    def squeeze(batches):
        """Equal segments of a task become one before they move, however many documents have them."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 300_000:
                yield from combine(pa.Table.from_batches(held)).select(["bin", "v", "before", "seg", "low", "high"]).to_batches(65_536)
                held, n = [], 0
        if held:
            yield from combine(pa.Table.from_batches(held)).select(["bin", "v", "before", "seg", "low", "high"]).to_batches(65_536)

    d = found.select(F.pmod("v", F.lit(bins)).alias("bin"), "v", "before", "seg", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"))
    distinct = d.mapInArrow(squeeze, "bin long, v long, before long, seg binary, low long, high long").repartition(bins, "bin").withColumn("sh", F.xxhash64("seg"))

    def judge(table: pa.Table) -> pa.Table:
        table = combine(table)
        segs, low, high = table.column("seg").to_pylist(), table.column("low").to_numpy(), table.column("high").to_numpy()
        least = earliest(segs, table.column("before").to_numpy(), low, length)
        use = [i for i, m in enumerate(least) if m.min() < high[i]]
        return pa.table({"v": table.column("v").take(pa.array(use, pa.int64())), "sh": table.column("sh").take(pa.array(use, pa.int64())), "least": pa.array([least[i].tobytes() for i in use], pa.binary())})

    judged = distinct.groupBy("bin").applyInArrow(judge, "v long, sh long, least binary")

    def spans(batches):
        """Strings of one segment lie closer together than their length: what goes runs from the first of them to the last one's end."""
        for b in batches:
            if not b.num_rows:
                continue
            doc, start, raw = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3)
            n = pc.binary_length(raw).to_numpy().astype(np.int64) // 8
            begin = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            at = np.flatnonzero(np.frombuffer(b"".join(raw.to_pylist()), np.int64) < doc[row])
            hit, row = at - begin[row[at]], row[at]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
            last = np.concatenate([first[1:] - 1, [len(row) - 1]]) if len(row) else first
            rows = row[first]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(start[rows] + hit[first]), pa.array(start[rows] + hit[last] + length)], ["doc_id", "th", "first", "last"])

    where = found.select("v", F.xxhash64("seg").alias("sh"), "doc_id", "th", "start").join(judged, ["v", "sh"]).select("doc_id", "th", "start", "least")
    whole = settled.filter(F.col("size") >= length).select("doc_id", "th", F.lit(0).cast("long").alias("first"), F.col("size").alias("last"))
    out = keep(where.mapInArrow(spans, "doc_id long, th long, first long, last long").unionByName(whole), "spans")
    drop_kept(found, settled)
    return out, count


def remove_repeats(docs: DataFrame, length: int = 50, digest: bool = False) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

    Strings are judged on the input, whole texts as UTF-8 bytes, never across documents. digest: returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row.
    Else the rows of docs with text (and n_chars, if there) changed; a span then gives up the bytes of characters that it holds
    only in part. Null texts count as empty and stay null; rows with null doc_id stay as they are and take nothing from others; rows
    that share an id take nothing from one another; rows stay as many as they are. An empty table gives no rows. A text may have up to 1 GiB; a larger
    one raises ValueError.
    """
    spans, count = removals(docs, length)
    columns = ["text"] if digest else docs.columns
    t = batches_of(docs, columns, count)
    fields = [docs.schema[c] for c in docs.columns]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[tuple, list] = {}
        for d, h, a, z in zip(*(right.column(c).to_pylist() for c in ("doc_id", "th", "first", "last")), strict=True):
            by.setdefault((d, h), []).append((a, z))
        rows, texts = [], []
        for d, h, text in zip(*(left.column(c).to_pylist() for c in ("__id", "__th", "text")), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            cuts = merged(np.array(by.get((d, h), []), np.int64).reshape(-1, 2))
            if not digest and len(cuts):
                b = np.frombuffer(raw + b" ", np.uint8)
                inside = (b & 0xC0) == 0x80
                for i, (a, z) in enumerate(cuts):
                    while inside[a]:
                        a += 1
                    while inside[z]:
                        z -= 1
                    cuts[i] = a, max(a, z)
            kept, at = [], 0
            for a, z in cuts.tolist():
                kept.append(raw[at:a])
                at = z
            left_over = b"".join([*kept, raw[at:]])
            texts.append(None if text is None else left_over.decode("utf-8", "surrogatepass") if not digest else None)
            if digest:
                rows.append((d, len(raw), len(raw) - len(left_over), len(cuts), hashlib.sha256(left_over).hexdigest()))
        if digest:
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, [pa.int64()] * 4 + [pa.string()], strict=True)})
        out = left.select([f.name for f in fields])
        out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in out.schema.names:
            i = out.schema.get_field_index("n_chars")
            out = out.set_column(i, "n_chars", pa.array([None if x is None else len(x) for x in texts], out.schema.field(i).type))
        return out

    spans = spans.withColumn("__batch", F.pmod(F.xxhash64("doc_id"), F.lit(count)))
    return t.groupBy("__batch").cogroup(spans.groupBy("__batch")).applyInArrow(apply, schema)
