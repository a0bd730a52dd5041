"""Packing token sequences into windows, by non-negative least squares over length combinations.

Documents are cut into full windows and a tail shorter than a window. The histogram of tail lengths, bounded by the window, is
all that the driver sees. Combinations of up to three lengths that fill a window exactly are enumerated; how often each
is used solves a non-negative least-squares problem against the histogram, is rounded down, and limited to what is there. The
residual is packed greedily, longest tails first, into windows that it fills exactly. Tails for which that does not come out are laid end
to end and cut at window borders; the last, part-filled window is cut into powers of two, which take no padding.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, keep, parts, worker

WINDOW, END = 2048, 1
#: Marks that are split off from letters before them.
MARKS = ".,;:!?#$%&*|"
#: Rows that share a tail length and a bucket, about; only these are ever ranked by one task.
BUCKET = 100_000


class WordIds:
    """Ids of whole texts, put together from those of space-separated words: this vocabulary drops white space, and neither its
    normaliser nor its patterns look beyond it. Words of letters go straight to the vocabulary's merges, others through the whole tokenizer.
    Ids of words are remembered, in bounded memory."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # How bytes are written: two-byte letters give every byte from 0x80, one character at a time.
        self.written = {i: chr(i) for i in range(128)}
        for c in map(chr, [*range(0xC0, 0x7C0), 0x4E00, *range(0x1000, 0xFFFF, 0x800)]):
            if c.isalpha():
                self.written |= dict(zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True))
        self.words = Memo(self.of_word)

    def of_word(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core and core[-1].isalpha() and "Σ" not in core and "İ" not in core and "<|" not in word:
            # The patterns split marks off the letters before them, and nothing before changes them.
            lower = core.lower()
            if lower != word:
                return self.words[lower] + (self.words[word[len(core) :]] if len(core) < len(word) else b"")
            if core.isalpha():
                if core.isascii():
                    return self.merged(core)
                if unicodedata.is_normalized("NFC", core) and (raw := core.encode()) and all(b in self.written for b in raw):
                    return self.merged("".join(map(self.written.__getitem__, raw)))
        return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def merged(self, letters: str) -> bytes:
        return array("H", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        ids = self.words.__getitem__
        return [b"".join(map(ids, t.replace("\n", " ").split(" "))) for t in texts]


_loaded: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = WordIds(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
    return _loaded[vocabulary]


def crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def tokenized(docs: DataFrame, vocabulary: str, window: int, end: int) -> DataFrame:
    """doc_id, doc_tokens, full (CRC of each full window), tail (16-bit ids), m (tail's length). Null texts have the end id alone."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def f(batches):
        encode, last = word_ids(vocabulary), np.array([end], "<u2").tobytes()
        with worker("packing", encode.words.forget):
            for b in parts(batches, 1):
                every = [x + last for x in encode([x or "" for x in b.column(1).to_pylist()])]
                cut = [len(x) // 2 // window * window * 2 for x in every]
                full = [[crc(x[i : i + 2 * window]) for i in range(0, c, 2 * window)] for x, c in zip(every, cut, strict=True)]
                tail = [x[c:] for x, c in zip(every, cut, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 2 for x in every], pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tail, pa.binary()), pa.array([len(x) // 2 for x in tail], pa.int32())], ["doc_id", "doc_tokens", "full", "tail", "m"])

    return docs.select("doc_id", "text").mapInArrow(f, f"doc_id {id_type}, doc_tokens long, full array<long>, tail binary, m int")


def combinations(hist: np.ndarray, window: int, frequent: int = 48) -> list[tuple[int, ...]]:
    """Up to three lengths that fill a window: all pairs, all with two equal lengths, and triples of frequent lengths."""
    out = {tuple(sorted((a, window - a))) for a in range(1, window // 2 + 1)}
    out |= {tuple(sorted((a, a, window - 2 * a))) for a in range(1, (window - 1) // 2 + 1)}
    top = [int(x) for x in np.argsort(-hist, kind="stable")[:frequent] if x and hist[x]]
    out |= {tuple(sorted((a, b, window - a - b))) for a in top for b in top if a <= b and a + b < window}
    return sorted(c for c in out if all(hist[x] for x in c))


def solve(columns: np.ndarray, parts: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with least squared difference between the lengths that x windows of each combination use and hist. Accelerated
    projected gradient; parts: combination of each entry of columns (its length)."""
    n = int(parts.max()) + 1
    uses = np.bincount(columns, minlength=len(hist))
    # A bound of the largest eigenvalue: most entries in a row times most in a column.
    rate = 1.0 / (uses.max() * 3.0)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        r = np.bincount(columns, y[parts], len(hist)) - hist
        z = np.maximum(0.0, y - rate * np.bincount(parts, r[columns], n))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / t2 * (z - x), z, t2
    return x


def filling(left: np.ndarray, first: int, window: int) -> tuple[int, ...] | None:
    """Greedily, lengths of which some are left and that fill a window exactly: `first`, then the longest that leaves no more than two
    others can fill, else the longest that fits. None if that does not come out."""
    have = left.copy()
    out, room = [first], window - first
    have[first] -= 1
    if have[first] < 0:
        return None
    while room:
        if have[room] > 0:
            return tuple(out) + (room,)
        a = np.arange(room - 1, (room - 1) // 2, -1)  # the longer of two that fill the room
        pair = a[(have[a] > 0) & (have[room - a] > (a == room - a))]
        if len(pair):
            return (*out, int(pair[0]), room - int(pair[0]))
        fits = np.flatnonzero(have[1:room] > 0)
        if not len(fits):
            return None
        m = int(fits[-1]) + 1
        out.append(m)
        have[m] -= 1
        room -= m
    return tuple(out)


class Plan:
    """Where the tail of length m and rank r goes. Bounded by the window's length, whatever the corpus."""

    def __init__(self, hist: np.ndarray, windows: int, window: int):
        self.window = window
        left = hist.astype(np.int64).copy()
        left[0] = 0
        combos = combinations(left, window)
        places, sequence = [], windows
        self.taken = np.zeros(len(hist), np.int64)
        if combos:
            columns = np.array([x for c in combos for x in c])
            parts = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
            x = np.floor(solve(columns, parts, left.astype(float)) + 1e-9).astype(np.int64)
            for k in np.argsort(-x, kind="stable"):
                c = combos[k]
                times = min(int(x[k]), *(int(left[m]) // c.count(m) for m in c))
                if times:
                    self.put(c, times, left, places, sequence)
                    sequence += times
        for length in range(window - 1, 0, -1):
            while c := filling(left, length, window):
                times = min(int(left[m]) // c.count(m) for m in c)
                self.put(c, times, left, places, sequence)
                sequence += times
        places.sort()
        self.key = np.array([(m << 40) + lo for m, lo, *_ in places], np.int64)
        self.place = places
        lengths = np.arange(len(hist), dtype=np.int64)
        self.stream = np.concatenate([[0], np.cumsum(left * lengths)])[:-1]
        self.first, total = sequence, int((left * lengths).sum())
        self.even = total // window * window
        rest, self.borders = total - self.even, [self.even]
        for p in range(window.bit_length() - 1, -1, -1):
            if rest >> p & 1:
                self.borders.append(self.borders[-1] + (1 << p))

    def put(self, combination: tuple[int, ...], times: int, left: np.ndarray, places: list, sequence: int) -> None:
        """The next `times` windows from `sequence` on get one tail of each length of the combination."""
        at = 0
        for m in combination:
            places.append((m, int(self.taken[m]), sequence, at))
            self.taken[m] += times
            left[m] -= times
            at += m

    def pieces(self, m: int, rank: int):
        """(begin, length, sequence, offset) of each piece of a tail."""
        if rank < self.taken[m]:
            _, lo, sequence, at = self.place[int(np.searchsorted(self.key, (m << 40) + rank, side="right")) - 1]
            yield 0, m, sequence + rank - lo, at
            return
        at, begin = int(self.stream[m]) + (rank - int(self.taken[m])) * m, 0
        while begin < m:
            if at < self.even:
                number, start = at // self.window, at // self.window * self.window
                stop = start + self.window
            else:
                k = next(i for i in range(1, len(self.borders)) if at < self.borders[i])
                number, start, stop = self.even // self.window + k - 1, self.borders[k - 1], self.borders[k]
            n = min(m - begin, stop - at)
            yield begin, n, self.first + number, at - start
            begin, at = begin + n, at + n


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece.

    Every row of docs (doc_id, text) is a document; null texts have the end id alone; rows stay as many as they are. Ranks of
    equal lengths are counted in two levels: within buckets of ids, and over the buckets' totals.
    """
    t = keep(tokenized(docs, vocabulary, window, end), "ids")
    by_length = t.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("w")).collect()
    hist, full = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for m, n, w in by_length:
        hist[m], full[m] = n, w
    before = np.concatenate([[0], np.cumsum(full)])[:-1]
    plan = Plan(hist, int(full.sum()), window)
    buckets = max(1, int(hist.max()) // BUCKET)
    r = t.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    up_to = Window.partitionBy("m").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = r.groupBy("m", "bucket").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("w")).select("m", "bucket", F.coalesce(F.sum("n").over(up_to), zero).alias("n"), F.coalesce(F.sum("w").over(up_to), zero).alias("w"))
    own = Window.partitionBy("m", "bucket").orderBy("doc_id", "doc_tokens", F.crc32("tail"), F.xxhash64("full"))
    r = r.withColumn("rank", F.row_number().over(own) - 1).withColumn("done", F.coalesce(F.sum(F.size("full")).over(own.rowsBetween(Window.unboundedPreceding, -1)), zero)).join(sums, ["m", "bucket"])
    r = r.select("doc_id", "doc_tokens", "full", "tail", "m", (F.col("rank") + F.col("n")).alias("rank"), (F.col("done") + F.col("w")).alias("done"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def f(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for doc, n, crcs, tail, m, rank, done in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                first = int(before[m]) + done
                rows = [(doc, i * window, window, c, n, first + i, 0) for i, c in enumerate(crcs)]
                at = len(crcs) * window
                rows += [(doc, at + begin, k, crc(tail[2 * begin : 2 * (begin + k)]), n, s, o) for begin, k, s, o in plan.pieces(m, rank)]
                for col, values in zip(out, zip(*rows, strict=True), strict=True):
                    col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.types[0]), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", *(x.split()[0] for x in PIECES.split(", "))])

    return r.mapInArrow(f, f"doc_id {id_type}, {PIECES}")
