"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled to three parts that are composed with each input: the normaliser (the file's character map, white-space
rules, dummy prefix, blanks to U+2581), the piece lattice (an arc for each piece and place) with byte-fallback arcs for characters
without a piece, and a weighting of adjacent arcs. The output is the path of least weight in the tropical semiring. Files with
user-defined or unused pieces, or with blanks as suffixes or unescaped, raise an error: their rules are not compiled.

For a unigram model an arc weighs its negative score. A byte-pair model has no additive scores: its merges are ranked. There the
weights are 0 and infinity, on pairs of adjacent arcs: a pair weighs 0 if the two pieces' own string merges to exactly these two.
A sequence in which every neighbouring pair is of that kind is the sequence that merging yields, and the only one, because the
first merge across a boundary would have to be the best one in the pair's own string as well. So the path of finite weight is
unique, each place keeps a single state, and the transducer gives the merge result (tests hold it against the library).

No piece has U+2581 after another character, so paths fall apart at blanks and results of such units are kept in a bounded memory.

Defined cases: null and empty texts give no ids and decode to the empty text; a null id is kept; repeated rows give repeated
results; an empty table gives an empty result. Decoding undoes encoding but for U+2581 in a text, which reads back as a blank, and for
what the file's character map changes. A text without blanks is one unit: its time is in proportion to its length. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

BLANK = "▁"
#: Units and pairs that a worker remembers before it starts afresh; units of the last such stretch stay at hand.
MEMORY = 350_000
#: Characters of a unit that is remembered.
LONG = 256


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and raw value."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({5: 4, 1: 8}[kind], i)
            value = b[i : i + n]
            i += n
        yield key >> 3, value


def trie(ids: dict[str, int]) -> dict:
    """Pieces by their characters; the empty key of a node holds the piece that ends there."""
    root: dict = {}
    for p, i in ids.items():
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = i
    return root


class Normaliser:
    """The normaliser of a model file: its character map, as the longest rule at each place, and its rules for white space."""

    def __init__(self, spec: dict):
        chars = spec.get(2, b"")
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if not spec.get(5, 1):
            raise ValueError("models that keep blanks as they are, are not compiled")
        self.rules = self.read(chars) if chars else {}
        self.longest = max(map(len, self.rules), default=0)
        self.first = {k[0] for k in self.rules}
        self.identity = not self.rules and not self.squeeze

    @staticmethod
    def read(chars: bytes) -> dict[str, str]:
        """The rules of a character map: a walk over all paths of its double array, whose leaves point to NUL-ended strings."""
        size = struct.unpack_from("<I", chars)[0]
        unit, strings = np.frombuffer(chars, "<u4", size // 4, 4).tolist(), chars[4 + size :]
        offset = lambda x: (x >> 10) << ((x & 512) >> 6)
        out, todo = {}, [(b"", offset(unit[0]))]
        while todo:
            key, base = todo.pop()
            for c in range(1, 256):
                x = unit[base ^ c] if base ^ c < len(unit) else 0
                if x & (1 << 31 | 255) != c:
                    continue
                after = base ^ c ^ offset(x)
                if x >> 8 & 1:
                    value = unit[after] & ((1 << 31) - 1)
                    out[(key + bytes([c])).decode()] = strings[value : strings.index(b"\0", value)].decode()
                todo.append((key + bytes([c]), after))
        return out

    def mapped(self, text: str) -> Iterator[str]:
        rules, i, n = self.rules, 0, len(text)
        while i < n:
            if text[i] not in self.first:
                yield text[i]
                i += 1
                continue
            e = next((e for e in range(min(n, i + self.longest), i, -1) if text[i:e] in rules), 0)
            yield rules[text[i:e]] if e else text[i]
            i = e or i + 1

    def __call__(self, text: str) -> str:
        out = "".join(self.mapped(text)) if self.rules and not self.first.isdisjoint(text) else text
        return " ".join(filter(None, out.split(" "))).rstrip(" " + BLANK) if self.squeeze else out


class Transducer(dict):
    """Maps a unit (less its first U+2581) to the bytes of its ids, little-endian 32-bit; units are composed when first asked for."""

    NORMAL, UNKNOWN, BYTE = 1, 2, 6

    def __init__(self, path: str):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.piece: list[tuple[str, float, int]] = []
        self.unigram, spec = True, {}
        with open(path, "rb") as f:
            for number, value in _message(f.read()):
                if number == 1:
                    d = dict(_message(value))
                    self.piece.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, 1)))
                elif number == 2:
                    trained = dict(_message(value))
                    self.unigram = trained.get(3, 1) == 1
                    if trained.get(3, 1) not in (1, 2) or trained.get(24, 0):
                        raise ValueError("only unigram and byte-pair models with blanks before words are compiled")
                elif number == 3:
                    spec = dict(_message(value))
        if any(kind in (4, 5) for _, _, kind in self.piece):
            raise ValueError("models with user-defined or unused pieces are not compiled")
        self.normal = Normaliser(spec)
        self.prefix = self.normal.prefix
        self.id = {p: i for i, (p, _, kind) in enumerate(self.piece) if kind == self.NORMAL}
        self.score = [s for _, s, _ in self.piece]
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.piece) if kind == self.BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.piece) if kind == self.UNKNOWN), 0)
        self.penalty = 10 - min((self.score[i] for i in self.id.values()), default=0.0)
        self.rank = {p: self.score[i] for p, i in self.id.items()}
        self.trie = trie(self.id)
        self.pair: dict[int, bool] = {}
        self.shown = [bytes([int(p[3:5], 16)]) if kind == self.BYTE else p.encode() if kind == self.NORMAL else b"" for p, _, kind in self.piece]
        self.shown[self.unknown] = " ⁇ ".encode()

    def weight(self, a: int, b: int) -> bool:
        """Whether the pair weighs 0; a is -1 at the start, -2 after a fallback arc."""
        key = (a + 2) << 32 | b
        if len(self.pair) >= 2 * MEMORY:
            self.pair.clear()
        first, second = self.piece[a][0] if a >= 0 else "", self.piece[b][0]
        self.pair[key] = self.apart(first, second)
        return self.pair[key]

    def apart(self, first: str, second: str) -> bool:
        """Whether the merges of two pieces' string make these pieces; the first merge across the boundary decides."""
        parts, rank, left = [*first, *second], self.rank, len(first)
        found = [rank.get(x + y, -math.inf) for x, y in zip(parts, parts[1:])]
        while found:
            top = max(found)
            if top == -math.inf:
                break
            k = found.index(top)
            if k == left - 1:
                return False
            left -= k < left
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k < len(found):
                found[k] = rank.get(parts[k] + parts[k + 1], -math.inf)
            if k:
                found[k - 1] = rank.get(parts[k - 1] + parts[k], -math.inf)
        return len(parts) == (2 if first else 1)

    def fallback(self, c: str) -> list[int]:
        return [self.byte[x] for x in c.encode()] if len(self.byte) == 256 else [self.unknown]

    def compose(self, s: str) -> list[int]:
        """The ids on the path of least weight through the lattice of a normalised string."""
        n, known, unigram = len(s), self.pair.get, self.unigram
        cost = [0.0] + [math.inf] * n
        back, last = [0] * (n + 1), [-1] * (n + 1)
        for b in range(n):
            if cost[b] == math.inf:
                continue
            before = (last[b] + 2) << 32
            if s[b] not in self.id:
                w = cost[b] + (self.penalty if unigram else 0.0)
                if w < cost[b + 1]:
                    cost[b + 1], back[b + 1], last[b + 1] = w, b, -2
            node, e = self.trie, b
            while e < n:
                node = node.get(s[e])
                if node is None:
                    break
                e += 1
                i = node.get("")
                if i is None:
                    continue
                if unigram:
                    w = cost[b] - self.score[i]
                elif cost[e] == 0.0:  # a place has one path of finite weight
                    continue
                else:
                    ok = known(before | i)
                    if ok is None:
                        ok = self.weight(last[b], i)
                    if not ok:
                        continue
                    w = 0.0
                if w < cost[e]:
                    cost[e], back[e], last[e] = w, b, i
        out, e = [], n
        while e:
            out.append(last[e])
            if last[e] == -2:
                out[-1:] = reversed(self.fallback(s[back[e] : e]))
            e = back[e]
        return out[::-1]

    def __missing__(self, unit: str) -> bytes:
        made = self.before.get(unit)
        if len(self) >= MEMORY:  # what was in use lately stays at hand
            self.before = dict(self)
            self.clear()
        if made is not None:
            self[unit] = made
            return made
        made = array("i", self.compose(BLANK + unit)).tobytes()
        if len(unit) <= LONG:
            self[unit] = made
        return made

    def encode(self, text: str) -> bytes:
        """The bytes of a text's ids."""
        if not self.normal.identity:
            text = self.normal(text)
        if not text:
            return b""
        s = (" " if self.prefix else "") + text
        if not self.prefix or "  " in s or BLANK in s or s[-1] == " " or self.unigram:
            return b"".join(self._unit(u) for u in self._units(s.replace(" ", BLANK)))
        return b"".join(map(self.__getitem__, text.split(" ")))

    def _units(self, s: str) -> Iterator[str]:
        """Stretches that begin where a run of U+2581 does."""
        start = 0
        while start < len(s):
            e = start
            while e < len(s) and s[e] == BLANK:
                e += 1
            e = s.find(BLANK, e) if e < len(s) else -1
            e = len(s) if e < 0 else e
            yield s[start:e]
            start = e

    def _unit(self, u: str) -> bytes:
        return self[u[1:]] if u[0] == BLANK else np.array(self.compose(u), "<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The transducer of a file; a worker keeps it, and what it remembers, over its tasks."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 (of little-endian 32-bit ids), round_trip: whether decoding gives the text again."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(path)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = [x or "" for x in part.column("t").to_pylist()]
                raw = [t.encode(x) for x in texts]
                flat = np.frombuffer(b"".join(raw), "<i4")
                at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                back = [t.decode(flat[at[i] : at[i + 1]]) == x for i, x in enumerate(texts)]
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(back)], ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """doc_id and the text that ids stand for."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(path)
        for b in batches:
            texts = [t.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
