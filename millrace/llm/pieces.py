"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

Blanks become the marker U+2581, one is put before a text, and the path of pieces with the largest
sum of scores is taken. A character that no piece begins with on the path becomes the pieces of its
UTF-8 bytes, and so does a marker that stands in the text itself, so decoding gives back every text.
No piece holds a line feed or has a marker after another character; so the best path of a text is
made of those of its units, runs of blanks with the word after them, and a task remembers the paths
of short units.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Added to the lowest score for a character without a piece.
UNKNOWN = -10.0
#: Units that a task remembers at once, and the longest of them.
CACHE_UNITS, CACHE_LENGTH = 400_000, 48


@dataclass(frozen=True)
class Pieces:
    """The pieces of a model by id: text, score and kind (1 normal, 2 unknown, 3 control, 4 given, 5 unused, 6 byte)."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            yield key >> 3, data[at : at + size]
            at += size


def read_pieces(path: str) -> Pieces:
    """The pieces of a SentencePiece model file; scores and kinds where they aren't the default."""
    texts, scores, kinds = [], [], []
    with open(path, "rb") as f:
        for number, value in fields(f.read()):
            if number == 1:
                own = dict(fields(value))
                texts.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, 1))
    return Pieces(texts, scores, kinds)


@dataclass(frozen=True)
class Trie:
    """A double array: the child of state s by code c is base[s] + c, if check of that is s.
    ``values`` has the id of the piece that ends in a state, or -1."""

    codes: dict[str, int]
    base: array
    check: array
    values: array


def build_trie(texts: dict[str, int]) -> Trie:
    """The trie of texts and their ids, breadth first, each state at the first base that is free."""
    counts: dict[str, int] = {}
    for t in texts:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    codes = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    base, check, values = array("i", [0]), array("i", [-1]), array("i", [-1])

    def grow(n: int) -> None:
        more = n - len(base)
        if more > 0:
            base.extend([0] * more)
            check.extend([-1] * more)
            values.extend([-1] * more)

    # Where the search for a place begins; it moves on when nearly all places up to there are taken.
    begin = 1
    level = [(0, sorted(texts), 0)]
    while level:
        following = []
        for state, some, depth in level:
            groups: dict[int, list[str]] = {}
            for t in some:
                if len(t) == depth:
                    values[state] = texts[t]
                else:
                    groups.setdefault(codes[t[depth]], []).append(t)
            if not groups:
                continue
            lowest, highest = min(groups), max(groups)
            place = max(begin, lowest + 1)
            taken, tried = 0, place
            while True:
                grow(place - lowest + highest + 1)
                if check[place] >= 0:
                    taken += 1
                elif all(check[place - lowest + c] < 0 for c in groups):
                    break
                place += 1
            if taken >= 0.9 * (place - tried + 1):
                begin = place
            at = place - lowest
            base[state] = at
            for c, own in groups.items():
                check[at + c] = state
                following.append((at + c, own, depth + 1))
        level = following
    grow(len(base) + len(codes) + 1)  # so that no step leaves the arrays
    return Trie(codes, base, check, values)


class Codec:
    """Encodes and decodes texts by the pieces of a model."""

    def __init__(self, pieces: Pieces, trie: Trie | None = None):
        self.pieces = pieces
        self.trie = trie or build_trie(trie_texts(pieces))
        self.base, self.check, self.values = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.values.tolist()
        self.unknown = min((s for s, k in zip(pieces.scores, pieces.kinds, strict=True) if k == 1), default=0.0) + UNKNOWN
        of_byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)) if k == 6}
        missing = next((i for i, k in enumerate(pieces.kinds) if k == 2), 0)
        self.of_byte = [of_byte.get(b, missing) for b in range(256)]
        self.kind = np.dtype("<u2") if len(pieces.texts) <= 1 << 16 else np.dtype("<u4")
        back = {i: bytes([b]) for b, i in of_byte.items()}
        self.surface = [back[i] if k == 6 else b"" if k in (2, 3) else t.replace(MARK, " ").encode() for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True))]
        self.units = re.compile(r" *[^ \n]+| +|\n")
        self.known: dict[str, bytes] = {}

    def path(self, unit: str) -> list[int]:
        """The ids of a unit: for each end the best start is kept, the earlier one if scores are equal."""
        base, check, values, scores, codes = self.base, self.check, self.values, self.pieces.scores, self.trie.codes
        n = len(unit)
        # A marker that stands in the text has code 0, a blank has the marker's.
        steps = [0 if c == MARK else codes.get(MARK if c == " " else c, 0) for c in unit]
        best, start, piece = [0.0] + [-1e300] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            state, here, single = 0, best[i], False
            for k in range(i, n):
                code = steps[k]
                after = base[state] + code
                if not code or check[after] != state:
                    break
                state = after
                found = values[state]
                if found >= 0:
                    if k == i:
                        single = True
                    score = here + scores[found]
                    if score > best[k + 1]:
                        best[k + 1], start[k + 1], piece[k + 1] = score, i, found
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], start[i + 1], piece[i + 1] = here + self.unknown, i, -1
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += [self.of_byte[b] for b in reversed(unit[start[n] : n].encode("utf-8", "replace"))]
            n = start[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian numbers of ``kind``; none for the empty text."""
        if not text:
            return b""
        known, out = self.known, []
        for unit in self.units.findall(" " + text):
            ids = known.get(unit)
            if ids is None:
                ids = np.array(self.path(unit), self.kind).tobytes()
                if len(unit) <= CACHE_LENGTH:
                    if len(known) >= CACHE_UNITS:
                        known.clear()
                    known[unit] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: markers become blanks, the one put before the text goes, byte pieces
        join to characters; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return text.decode("utf-8", "replace").removeprefix(" ")


def trie_texts(pieces: Pieces) -> dict[str, int]:
    """The pieces that a path may use: normal and given ones; of equal texts the first."""
    out: dict[str, int] = {}
    for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)):
        if k in (1, 4) and t:
            out.setdefault(t, i)
    crossing = [t for t in out if "\n" in t or MARK in t.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces go beyond a unit: {crossing[:3]}")
    return out


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int) and decoded, their text again.

    Null is the empty text, which has no ids. Repeated rows stay; long texts are encoded unit by
    unit; an empty table gives an empty result; extra columns are left behind.
    """
    pieces = read_pieces(path)
    trie = build_trie(trie_texts(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces, trie)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows = [np.frombuffer(codec.encode(t.as_py()), codec.kind) for t in some.column(1)]
                ids = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *(len(r) for r in rows)]), pa.int32()), pa.array(np.concatenate(rows).astype(np.int32) if rows else [], pa.int32())
                )
                yield pa.record_batch([some.column(0), ids, pa.array([codec.decode(r) for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``encode_documents`` makes, as digests: doc_id, n_tokens, n_byte_tokens, ids_crc32 (of
    little-endian unsigned 32-bit numbers), decoded_sha256, and round_trip, whether decoding gave
    the text back."""
    pieces = read_pieces(path)
    trie = build_trie(trie_texts(pieces))
    is_byte = np.array([k == 6 for k in pieces.kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces, trie)
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py()
                ids = np.frombuffer(codec.encode(text), codec.kind)
                decoded = codec.decode(ids)
                digest = hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()
                out.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), digest, decoded == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return rows.mapInArrow(run, schema)
