"""SentencePiece encoding with byte offsets, and decoding.

``Normalizer`` follows the model's compiled character map: a double-array trie over UTF-8, of which the longest prefix
at each place is replaced, and every normalised byte remembers the source byte it came from. ``Encoder.encode`` merges
pairs best score first (leftmost on ties), falls back to bytes, and projects each piece to its span of source bytes.

A piece never reaches from a non-blank over a following blank symbol (checked when the model is read), nor over a
character that no longer piece holds. So a text falls apart into chunks that are encoded alone, and a chunk's ids are
remembered; the memory has two generations of CHUNKS chunks and is bounded. If a model breaks that rule, the whole
text is one chunk. Where every id tells its bytes (a piece by its length, a byte by itself), the spans of a text come
from its ids and the alignment in a few array steps.

Defined results: a null text counts as empty and has no ids. Rows that repeat are encoded each by itself. Only doc_id
and text are read; other columns, of any name, don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import prepare, texts_of

SPACE = "▁"
CHUNKS = 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NEVER = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message, undecoded."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : (at := at + n)]
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : (at := at + n)]


@dataclass
class Normalizer:
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    units: list[int] = field(init=False)
    strings: bytes = field(init=False)

    def __post_init__(self) -> None:
        n = struct.unpack_from("<I", self.charsmap)[0] if self.charsmap else 0
        self.units = list(struct.unpack_from(f"<{n // 4}I", self.charsmap, 4)) if n else []
        self.strings = self.charsmap[4 + n :]

    @property
    def identity(self) -> bool:
        return not self.units and not self.squeeze and self.escape

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the longest mapped prefix at ``at`` becomes and how many bytes it takes; one character if none is."""
        size, value = 0, 0
        if self.units:
            node = self._offset(self.units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                if node >= len(self.units):
                    break
                unit = self.units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= self._offset(unit)
                if unit >> 8 & 1:
                    size, value = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if size:
            return self.strings[value : self.strings.index(b"\0", value)], size
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes (and the end) the source byte."""
        data = text.encode("utf-8", "replace")
        space = SPACE.encode() if self.escape else b" "
        out, source, at = bytearray(), [], 0

        def put(piece: bytes, origin: int) -> None:
            out.extend(piece)
            source.extend([origin] * len(piece))

        if self.squeeze:
            while at < len(data):
                piece, size = self.longest(data, at)
                if piece != b" ":
                    break
                at += size
        if at == len(data):
            return "", [at]
        if self.dummy_prefix:
            put(space, at)
        blank = self.squeeze
        while at < len(data):
            piece, size = self.longest(data, at)
            while blank and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for i in range(len(piece)):
                    put(space if piece[i : i + 1] == b" " else piece[i : i + 1], at)
                blank = self.squeeze and piece.endswith(b" ")
            at += size
        end = at
        while self.squeeze and out.endswith(space):
            end = source[len(out) - len(space)]
            del out[len(out) - len(space) :], source[-len(space) :]
        return out.decode("utf-8", "replace"), [*source, end]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """``normalize``; where the model's map is empty and nothing is squeezed, without a step for each character:
        all bytes of a character come from its first one."""
        data = text.encode("utf-8", "replace")
        if not self.identity or not data:
            norm, source = self.normalize(text)
            return norm, np.array(source, np.int64)
        b = np.frombuffer(data, np.uint8)
        kind = np.int32 if len(data) < 1 << 30 else np.int64
        source = np.arange(len(b) + 1, dtype=kind)
        if not data.isascii():
            source[:-1] = np.maximum.accumulate(np.where(b & 0xC0 != 0x80, source[:-1], 0))
        if b" " in data:
            source = np.repeat(source, np.where(np.append(b, 0) == 32, 3, 1))
        norm = data.replace(b" ", SPACE.encode()).decode()
        if self.dummy_prefix:
            return SPACE + norm, np.concatenate([np.zeros(3, kind), source])
        return norm, source


class _Memo(dict):
    """chunk -> its ids, packed, in two generations."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, chunk: str):
        ids = self.old.get(chunk) or self.make(chunk)
        if len(chunk) <= 48:
            if len(self) >= CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, model: bytes):
        self.pieces, self.types, self.score, self.id_of = [], [], {}, {}
        self.unknown, self.byte_ids, fallback, norm = 0, [0] * 256, False, {}
        for no, value in _fields(model):
            if no == 1:
                p = dict(_fields(value))
                piece, kind = p[1].decode(), p.get(3, NORMAL)
                i = len(self.pieces)
                self.pieces.append(piece)
                self.types.append(kind)
                if kind == NORMAL:
                    self.score[piece], self.id_of[piece] = struct.unpack("<f", p[2])[0] if 2 in p else 0.0, i
                elif kind == UNKNOWN:
                    self.unknown = i
                elif kind == BYTE:
                    self.byte_ids[int(piece[3:5], 16)] = i
                elif kind in (USER, UNUSED):
                    raise ValueError("user-defined and unused pieces aren't supported")
            elif no == 2:
                t = dict(_fields(value))
                fallback = bool(t.get(35, 0))
                if t.get(3, 1) != 2 or t.get(24, 0):
                    raise ValueError("only BPE models with blanks in front are supported")
            elif no == 3:
                norm = dict(_fields(value))
        self.fallback = fallback
        self.normalizer = Normalizer(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        longer = [p for p in self.score if len(p) > 1]
        apart = all(SPACE not in p.lstrip(SPACE) for p in longer)
        line = "" if any("\n" in p for p in longer) else "\n"
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else "") if apart else "(?s:.+)").findall
        self.memo = _Memo(lambda chunk: array("i", self._ids(chunk)).tobytes())
        self.loss = {p: -x for p, x in self.score.items()}
        # id -> its text; a byte above 127 is kept as a lone surrogate until all of its character is there
        self.texts = [p.replace(SPACE, " ") if k == NORMAL else bytes([int(p[3:5], 16)]).decode("ascii", "surrogateescape") if k == BYTE else " ⁇ " if k == UNKNOWN else "" for p, k in zip(self.pieces, self.types)]
        self.decimals = [str(i) for i in range(len(self.pieces))]
        # id -> the normalised bytes that it stands for, and the byte of a byte piece (-1 for others)
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.types)], np.int32)
        self.bytes = np.full(len(self.pieces), -1, np.int32)
        for b, i in enumerate(self.byte_ids if fallback else ()):
            self.bytes[i] = b

    def merge(self, chunk: str) -> list[str]:
        """The pieces of a chunk, each a normal piece or one character."""
        s, loss = list(chunk), self.loss
        if len(s) > 40:
            return self._merge_long(s)
        pairs = [loss.get(a + b, _NEVER) for a, b in zip(s, s[1:])]
        while pairs:
            best = min(pairs)
            if best == _NEVER:
                return s
            at = pairs.index(best)  # the leftmost
            s[at] += s.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = loss.get(s[at - 1] + s[at], _NEVER)
            if at < len(pairs):
                pairs[at] = loss.get(s[at] + s[at + 1], _NEVER)
        return s

    def _merge_long(self, s: list[str]) -> list[str]:
        """The same with a heap and a linked list, for chunks of any length."""
        n, score = len(s), self.score
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (x := score.get(s[a] + s[b])) is not None:
                heapq.heappush(heap, (-x, a, b, s[a] + s[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, piece = heapq.heappop(heap)
            if not s[a] or not s[b] or right[a] != b or s[a] + s[b] != piece:
                continue
            s[a], s[b] = piece, ""
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in s if x]

    def _units(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "replace")] if self.fallback else [self.unknown]

    def _ids(self, chunk: str) -> list[int]:
        pieces = self.merge(chunk)
        try:
            return [self.id_of[p] for p in pieces]
        except KeyError:
            return [i for p in pieces for i in self._units(p)]

    def normalized(self, text: str) -> str:
        if self.normalizer.identity:
            return (SPACE if self.normalizer.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""
        return self.normalizer.normalize(text)[0]

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit numbers of the machine's order."""
        return b"".join(map(self.memo.__getitem__, self.chunks(self.normalized(text))))

    def ids(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def ids_text(self, ids: list[int]) -> str:
        """Decimals with commas."""
        return ",".join(map(self.decimals.__getitem__, ids))

    def encode(self, text: str) -> list[tuple[int, str, int, int]]:
        """(id, piece, first and past-last source byte) of every piece. A character's byte pieces share its span."""
        norm, source = self.normalizer.normalize(text)
        out, at = [], 0
        for chunk in self.chunks(norm):
            for p in self.merge(chunk):
                end = at + len(p.encode("utf-8", "replace"))
                out += [(i, self.pieces[i] if self.types[i] != UNKNOWN else p, source[at], source[end]) for i in self._units(p)]
                at = end
        return out

    def placed(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``encode`` and its spans (pieces x 2), with the memory of chunks."""
        if not self.fallback:  # an unknown piece doesn't tell its bytes
            found = self.encode(text)
            return np.array([p[0] for p in found], np.int32), np.array([p[2:] for p in found], np.int64).reshape(-1, 2)
        norm, source = self.normalizer.aligned(text)
        ids = np.frombuffer(b"".join(map(self.memo.__getitem__, self.chunks(norm))), np.int32)
        ends = np.cumsum(self.sizes[ids])
        begins = ends - self.sizes[ids]
        at = np.flatnonzero(self.bytes[ids] >= 0)
        if len(at):  # the bytes of a character share its span
            lead = self.bytes[ids[at]] & 0xC0 != 0x80
            first = at[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            head = self.bytes[ids[first]]
            begins[at] = begins[first]
            ends[at] = begins[first] + 1 + (head >= 0xC0) + (head >= 0xE0) + (head >= 0xF0)
        return ids, np.stack([source[begins], source[ends]], 1)

    def decode_fast(self, ids: list[int]) -> str:
        """``decode``; text without broken characters takes the short way."""
        if not ids:
            return ""
        if not (self.types[ids[0]] == NORMAL and self.pieces[ids[0]].startswith(SPACE) and self.normalizer.dummy_prefix and not self.normalizer.squeeze):
            return self.decode(ids)
        out = "".join(map(self.texts.__getitem__, ids))[1:]
        try:
            out.encode()
            return out
        except UnicodeEncodeError:
            pass
        try:
            return out.encode("utf-8", "surrogateescape").decode()
        except UnicodeDecodeError:
            return self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        out, run, first = [], bytearray(), True
        strip = self.normalizer.dummy_prefix or self.normalizer.squeeze
        for i in ids:
            if self.types[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(_utf8(run))
                run, first = bytearray(), False
            if self.types[i] == CONTROL:
                continue
            piece = " ⁇ " if self.types[i] == UNKNOWN else self.pieces[i]
            if first and strip and piece.startswith(SPACE):
                piece = piece[1:]
                first = self.normalizer.squeeze and not piece
            else:
                first = False
            out.append(piece.replace(SPACE, " "))
        return "".join(out) + _utf8(run)


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that isn't part of a character becomes U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_loaded: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder of a model in a process."""
    key = hashlib.sha1(model).digest()
    if key not in _loaded:
        _loaded[key] = Encoder(model)
    return _loaded[key]


def spans(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and pieces: array of (id, piece, begin, end) over the text's bytes."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("id", pa.int32()), ("piece", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        for b in batches:
            rows = [[dict(zip(("id", "piece", "begin", "end"), p)) for p in e.encode(t)] for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pieces array<struct<id int, piece string, begin long, end long>>")


def digests(docs: DataFrame, model: bytes, with_spans: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_spans: also spans_sha256, of the pieces' first and
    past-last source bytes as little-endian 64-bit numbers."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(sent.value)
        for b in batches:
            n, ids, back, spans_ = [], [], [], []
            for t in texts_of(b):
                x, at = e.placed(t)
                spans_.append(hashlib.sha256(at.astype("<i8").tobytes()).hexdigest())
                x = x.tolist()
                n.append(len(x))
                ids.append(hashlib.sha256(e.ids_text(x).encode()).hexdigest())
                back.append(hashlib.sha256(e.decode_fast(x).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array(spans_)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    return out if with_spans else out.drop("spans_sha256")
