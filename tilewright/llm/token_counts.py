"""Token counts by a deterministic transducer compiled from a sentencepiece BPE vocabulary.

A sequence of pieces is what BPE makes of a text exactly if BPE leaves each piece and each two neighbours as they are. So every prefix of a text ends
in one certain piece: the one whose beginning follows a prefix with which it goes together. A state therefore holds the longest end of the
text read that a piece can still continue, and for each place in it the piece that ends there and how many tokens lie between there and here. Reading
a character leads to one next state and emits a number of tokens (less than none where pieces join). States are
compiled as texts reach them and interned, as there are many; what they emit is then a look-up a character.

No piece has a space after another character, and none has a line break: there the state starts anew. Paths between such places recur,
and are remembered as one transition. A chunk of text is a map from the state before it to (tokens emitted, state after): up to its first new start it
depends on the state that comes in, after it not. Such maps compose associatively; `scan` folds them as a tree of parallel prefixes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import Memo, parts, utf8_bytes, worker

CHUNK = 1 << 16
SPACE = "▁"
#: Transitions that a worker keeps; beyond that all are forgotten and compiled anew.
TRANSITIONS = 300_000
#: Kinds of pieces in a model file.
NORMAL, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 3, 4, 5, 6

_runs = re.compile(" *[^ \n]+| +|\n")
_start = re.compile("(?<=[^ ]) |(?<=\n)|\n")


class ChunkMap(NamedTuple):
    """head: up to the first new start; tokens: those after it; state: after the chunk. A chunk without a new start has state None."""

    head: str
    tokens: int
    state: str | None


class Transducer:
    """A state is named by a string: the longest end of what was read that begins a longer piece, and for each place in it, from its beginning
    on, two characters: what stands before it (DEAD: no longer piece goes on from there; FREE: nothing that matters), and the tokens up to
    there, those up to the end of what was read being NOUGHT. Before the last place that is the number of a piece, of all with the same right edge
    the first; before others the number of a fence: the starts y of later pieces that the piece there takes, by merges of at most which score."""

    DEAD, FREE, FIRST, NOUGHT = 0, 1, 2, 64
    ROOT = chr(FREE) + chr(NOUGHT)

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        norm, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.pieces = list(self.score)
        self.letters = {c for p in self.score for c in p}
        self.longer = {p[:i] for p in self.score for i in range(1, len(p))}
        #: Other models' texts are given to the library whole.
        self.compiles = (
            proto.trainer_spec.model_type == 2
            and proto.trainer_spec.byte_fallback
            and not kinds & {USER_DEFINED, UNUSED}
            and self.letters <= self.score.keys()
            and len(self.pieces) < 50_000
            and not any(b == SPACE != a for p in self.score for a, b in zip(p, p[1:], strict=False))
            and "\n" not in self.letters
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
        )
        self.sorted, self.spines, self.numbered, classes = sorted(self.score), {}, {}, {}
        if self.compiles:
            for i, p in enumerate(self.pieces):
                self.spines |= (found := self.spines_of(p))
                for left, right in found.values():
                    self.numbered[p] = classes.setdefault((p if p[-1] == SPACE else "", *right), i) + self.FIRST
        self.runs = Memo(lambda run: self.walk(self.ROOT, run)[1], 48 << 20)
        self.forget()

    def forget(self) -> None:
        """Nothing but what the constructor made. Names of states held elsewhere lose their meaning."""
        self.runs.forget()
        self.reset()
        self.fences, self.fence_numbers, self.after = [{}, {}], {frozenset(): self.FREE}, {}

    def reset(self) -> None:
        """No states but the root, number 0; no transitions. next: number of a state << 21 | character -> number of the next << 6 | tokens + 32."""
        self.names, self.numbers, self.next = [self.ROOT], {self.ROOT: 0}, {}

    def number(self, name: str) -> int:
        n = self.numbers.setdefault(name, len(self.names))
        if n == len(self.names):
            self.names.append(name)
        return n

    def merged(self, text: str) -> list[tuple]:
        """The merges of a short text, the best first, the leftmost of equals: a tree (piece, left, right) for each piece left."""
        s = [(c, None, None) for c in text]
        while True:
            best, at = None, 0
            for i in range(len(s) - 1):
                score = self.score.get(s[i][0] + s[i + 1][0])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return s
            s[at : at + 2] = [(s[at][0] + s[at + 1][0], s[at], s[at + 1])]

    def spines_of(self, piece: str) -> dict:
        """For a piece that BPE leaves whole: the pieces along its left and its right edge that others can be joined to, each with the
        score of the merge in which it ends (None: it stays). Pieces that fall apart have no entry."""
        tree = self.merged(piece)
        if len(tree) > 1:
            return {}
        edges = []
        for side in (1, 2):
            node, ends, out = tree[0], None, []
            while node:
                out.append((node[0], ends))
                ends, node = self.score[node[0]], node[side]
            edges.append(out)
        return {piece: (edges[0], [(p, e) for p, e in edges[1] if p in self.longer])}

    def fence(self, starts: dict) -> int:
        n = self.fence_numbers.setdefault(frozenset(starts.items()), len(self.fences))
        if n == len(self.fences):
            self.fences.append(starts)
        return n

    def fence_after(self, number: int, letter: str) -> int:
        """The fence of a piece, for pieces that begin with a letter: each y of them that a part x of its right edge can be joined to, before the merge
        in which x ends. A merge's score is below those of its parts, but for runs of spaces: these keep the piece."""
        if number == self.FREE:
            return self.FREE
        out = self.after.get((number, letter))
        if out is None:
            piece, starts = self.pieces[number - self.FIRST], {}
            if piece[-1] == SPACE == letter:
                starts[None] = piece
            else:
                for x, ends in self.spines[piece][1]:
                    for z in self.sorted[bisect_left(self.sorted, x + letter) : bisect_left(self.sorted, x + letter + chr(0x10FFFF))]:
                        y, score = z[len(x) :], self.score[z]
                        if y in self.spines and (ends is None or score > ends) and score > starts.get(y, -1e30):
                            starts[y] = score
            out = self.after[number, letter] = self.fence(starts)
        return out

    def within(self, fence: int, start: str) -> int:
        """What is left of a fence for pieces that begin with `start`."""
        starts = self.fences[fence]
        return fence if not starts or None in starts else self.fence({y: v for y, v in starts.items() if y.startswith(start) or start.startswith(y)})

    def stands(self, fence: int, piece: str) -> bool:
        """Whether a piece is left as it is behind a fence: no merge across comes before the one that ends a part of its left edge."""
        starts = self.fences[fence]
        if None in starts:
            return [x[0] for x in self.merged(starts[None] + piece)] == [starts[None], piece]
        for y, ends in self.spines[piece][0] if starts else ():
            if y in starts and (ends is None or starts[y] >= ends):
                return False
        return True

    def compile(self, state: int, char: str) -> int:
        """The transition from a state by a character."""
        name, letter = self.names[state], SPACE if char == " " else char
        m = (len(name) - 2) // 3
        before = ord(name[-2])
        full = len(self.next) >= TRANSITIONS
        if letter not in self.letters:  # its bytes
            out = 32 + len(char.encode("utf-8", "surrogatepass"))
        elif char == " " and before != self.FREE and self.pieces[before - self.FIRST][-1] != SPACE:
            out = self.compile(0, char)
        else:
            text, ends, longer = name[:m] + letter, name[m:], self.longer
            fences = [*map(ord, ends[0 : 2 * m : 2]), self.fence_after(before, letter)]
            for i, fence in enumerate(fences):
                if fence and (last := text[i:]) in self.spines and self.stands(fence, last):
                    break
            else:
                raise AssertionError("a text without its last piece")
            n, cut = ord(ends[2 * i + 1]) - self.NOUGHT + 1, 0
            while text[cut:] and text[cut:] not in longer:
                cut += 1
            # Places from which no longer piece goes on do not matter any more.
            places = "".join(chr(self.within(fences[i], text[i:])) + chr(ord(ends[2 * i + 1]) - n) if fences[i] and text[i:] in longer else "\0\0" for i in range(cut, m + 1))
            to = text[cut:] + places + chr(self.numbered[last]) + chr(self.NOUGHT)
            if full:
                self.reset()
            out = self.number(to) << 6 | n + 32
        if not full:
            self.next[state << 21 | ord(char)] = out
        return out

    def walk(self, name: str, text: str) -> tuple[str, int]:
        """The state after a text, from a state, and the tokens emitted."""
        state, n, get = self.number(name), -32 * len(text), self.next.get
        for c in text:
            v = get(state << 21 | ord(c))
            if v is None:
                v, get = self.compile(state, c), self.next.get
            state = v >> 6
            n += v & 63
        return self.names[state], n

    def chunk_map(self, text: str, first: bool) -> ChunkMap:
        """first: the text's beginning, a new start."""
        head = ""
        if not first:
            m = _start.search(text)
            if m is None:
                return ChunkMap(text, 0, None)
            head, text = text[: m.start()], text[m.start() :]
        runs = _runs.findall(text)
        state, n = self.walk(self.ROOT, runs.pop()) if runs else (self.ROOT, 0)
        return ChunkMap(head, n + sum(map(self.runs.__getitem__, runs)), state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.state is None:
            a = self.chunk_map(a.head + b.head, False)
            if a.state is None:
                return ChunkMap(a.head, b.tokens, b.state)
            return a if b.state is None else ChunkMap(a.head, a.tokens + b.tokens, b.state)
        state, n = self.walk(a.state, b.head)
        return ChunkMap(a.head, a.tokens + n + b.tokens, state if b.state is None else b.state)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.compiles:
            return len(self.model.encode(text, num_threads=1))
        text = " " + text.replace(SPACE, " ")
        return self.scan([self.chunk_map(text[i : i + CHUNK], i == 0) for i in range(0, len(text), CHUNK)]).tokens


_compiled: dict[str, Transducer] = {}


def transducer(model: str) -> Transducer:
    if model not in _compiled:
        _compiled[model] = Transducer(public_tokenizers.path(model) if "/" not in model else model)
    return _compiled[model]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes long, n_tokens long of each row, with the texts whole.

    Null and empty texts have 0 of both; repeated rows and null ids stay as they are; an empty table gives no rows; other columns are left out
    whatever their names. No row leaves its task: one narrow pass, Arrow batches in, two numbers a row out.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"

    def f(batches):
        t = transducer(model)
        with worker("token_counts", t.forget):
            for b in parts(batches, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([t.count(x) for x in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), utf8_bytes(F.col(text_col)).alias("n_bytes")).mapInArrow(f, schema)
