"""Removal of repeated byte strings by blockwise suffix sorting with difference-cover samples.

A string of ``length`` bytes goes where a document with a smaller id has it too. Documents stand in
ascending id order in chunks of a few megabytes, so "in a smaller document" is "in an earlier chunk,
or earlier in the chunk". Suffixes are sorted one bucket of keys at a time, and only those that can
matter are sorted at all:

1. The cover sample. Positions that fall, modulo 31, into a perfect difference set are sampled. Two
   equal strings at any two positions have a sampled position in common within 31 bytes, so equal
   strings of 50 bytes have a common sample of 20 bytes. Sample keys are sorted bucket by bucket;
   samples that no other document shares are done with.
2. Long ties. Where two documents agree over 80 bytes a shared sample ranks the agreement: its key
   over 80 bytes is sorted in the same way, and if an earlier document has it, all 31 suffixes that
   begin in its first 31 bytes are resolved at once.
3. The rest, mostly suffixes near the ends of agreements, are sorted by the key of their first 50
   bytes, bucket by bucket. A run of equal keys belongs to its first document.

Keys are hashes: suffixes matter here only as runs of equal ones, not by their order. What equal keys
claim is then checked on the bytes. Each claimed position names the first chunk that has its key;
runs of claims travel there as one piece of text, and its bytes are compared. Strings of which a claim
fails are in doubt, and only they are looked at once more: all positions that have one are sorted by
keys of another hash function, which are few and so hardly ever collide, and what these claim is
checked in the same way. So a result never rests on a hash, and no number of keys is too many; a look
sorts nothing anew, and makes anew only what chunks that have such a string lose.

Keys travel as sorted, delta-coded arrays, a row for each chunk and bucket, each key once for a chunk;
so a passage that many documents share costs a key for each chunk. Tasks hold a chunk or a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, let_go, shared_path, stored

PERIOD = 31
#: A perfect difference set, whose differences are all numbers modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
CHUNK_BYTES = 4 << 20
#: Keys that a task sorts at once, about.
BUCKET_KEYS = 4_000_000
REST_PARTS = 2
#: A sample key has so many bits more than it takes to number all samples: a chance agreement costs
#: time, not rightness, so few bits do.
SPARE_BITS = 11
#: Bits of the keys that decide.
KEY_BITS = 62
#: Bytes of claims that are checked at once against a chunk, about.
CLAIM_BYTES = 8 << 20
#: Strings in doubt that one look settles; any others are left to the next one.
MOST_DOUBTS = 1 << 20
#: Positions hashed at once, so that what lies between stays in the cache.
BLOCK = 1 << 14


def factors(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position of ``data``, which has 8 bytes more."""
    return np.ascontiguousarray(np.ndarray(len(data) - 7, "<u8", data, strides=(1,)))


def keys_at(data: np.ndarray, at: np.ndarray, length: int, bits: int, odd: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Hashes, by the ``factors`` odd, of the ``length`` bytes from each position of ``at``; ``data``
    has 8 bytes more. ``words`` of it make many or long strings faster."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)) if words is None else words
    keys = np.empty(len(at), np.uint64)
    for block in range(0, len(at), BLOCK):
        own = at[block : block + BLOCK]
        out = np.full(len(own), length, np.uint64)
        for k, start in enumerate(range(0, length, 8)):
            x = words[own + start]
            if start + 8 > length:
                x &= np.uint64((1 << 8 * (length - start)) - 1)
            x ^= out
            x *= odd[k]
            np.right_shift(x, np.uint64(29), out=out)
            out ^= x
        out *= odd[-1]
        out ^= out >> np.uint64(32)
        keys[block : block + BLOCK] = out >> np.uint64(64 - bits)
    return keys


def pack(keys: np.ndarray) -> bytes:
    """Ascending distinct keys as a first byte, the width, the first key, and differences of so many bytes."""
    steps = keys[1:] - keys[:-1]
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) == 1:
        return np.zeros(0, np.uint64)
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, count=8, offset=1)
    steps[1:, :width] = raw
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def find(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each of ``keys`` its index in the ascending array ``of``, or -1.

    A table of slots tells most; only keys whose slot others share are searched for."""
    if not len(of) or not len(keys):
        return np.full(len(keys), -1, np.int64)
    if len(keys) < 1000 or len(of) >= 1 << 27:
        at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
        return np.where(of[at] == keys, at, -1)
    bits = max(12, min(24, len(of).bit_length() + 3))
    slot = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    table, own = np.full(1 << bits, -1, np.int32), slot(of)
    table[own] = np.arange(len(of), dtype=np.int32)
    out = table[slot(keys)].astype(np.int64)
    missed = np.flatnonzero((out >= 0) & (of[out] != keys))
    out[missed] = -1
    lost = np.flatnonzero(table[own] != np.arange(len(of)))
    if len(lost) and len(missed):
        at = np.minimum(np.searchsorted(of[lost], keys[missed]), len(lost) - 1)
        here = of[lost[at]] == keys[missed]
        out[missed[here]] = lost[at[here]]
    return out


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in the ascending array ``of``."""
    return find(keys, of) >= 0


def later_copies(keys: np.ndarray, owners: np.ndarray, every: bool, elsewhere: np.ndarray | None = None) -> np.ndarray:
    """Which keys a smaller owner has too; with ``every``, which another owner has. Keys of the
    ascending array ``elsewhere`` are found in any case."""
    out = np.zeros(len(keys), bool) if elsewhere is None else member(keys, elsewhere)
    ordered = np.sort(keys)
    some = np.flatnonzero(member(keys, distinct(ordered[1:][ordered[1:] == ordered[:-1]])))
    if not len(some):
        return out
    order = some[np.argsort(keys[some])]
    k, o = keys[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    first = np.minimum.reduceat(o, starts)
    if every:
        out[order] |= np.repeat(np.maximum.reduceat(o, starts) > first, sizes)
    else:
        out[order] |= o > np.repeat(first, sizes)
    return out


def distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def first_of(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each key the index of the one equal to it that has the smallest owner."""
    order = np.lexsort((owners, keys))
    k = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(order[starts], np.diff(np.append(starts, len(k))))
    return out


def differ(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """At which of the positions ``a`` of ``x`` the next bytes aren't those at ``b`` of ``y``. Strings
    that overlap, as far apart in both, are compared as one."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), BLOCK):
        at, to = a[k : k + BLOCK], b[k : k + BLOCK]
        step = at[1:] - at[:-1]
        fresh = np.concatenate([[True], (step < 0) | (step > length) | (to[1:] - to[:-1] != step)])
        begins = np.flatnonzero(fresh)
        sizes = at[np.append(begins[1:], len(at)) - 1] + length - at[begins]
        before = np.cumsum(sizes) - sizes
        within = np.arange(sizes.sum()) - np.repeat(before, sizes)
        wrong = x[within + np.repeat(at[begins], sizes)] != y[within + np.repeat(to[begins], sizes)]
        so_far = np.concatenate([[0], np.cumsum(wrong)])
        run = np.cumsum(fresh) - 1
        place = at - at[begins][run] + before[run]
        out[k : k + BLOCK] = so_far[place + length] > so_far[place]
    return out


@dataclass(frozen=True)
class Hashing:
    """The length of a repeated string, the bits of sample keys and of keys that decide, and a seed."""

    length: int
    sample_bits: int
    key_bits: int
    seed: int


@dataclass
class Look:
    """Strings in doubt, as ascending keys by the hash function of ``seed``."""

    seed: int
    wanted: np.ndarray


def doubts(data: np.ndarray, at: np.ndarray, starts: int, length: int, seed: int) -> np.ndarray:
    """Keys, for a look of that seed, of the strings from each position of ``at`` and the ones after it."""
    places = (at[:, None] + np.arange(starts)).ravel()
    return np.unique(keys_at(data, places, length, KEY_BITS, factors(seed)))


class Chunk:
    """The texts of a chunk as one array of bytes, and what of them is repeated."""

    def __init__(self, batch: pa.RecordBatch, how: Hashing):
        self.batch, self.length, self.how, self.odd = batch, how.length, how, factors(how.seed)
        texts = batch.column("text")
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        size = int(offsets[-1] - offsets[0]) if len(offsets) else 0
        self.data = np.zeros(size + 8, np.uint8)
        if size:
            self.data[:size] = np.frombuffer(raw, np.uint8, count=size, offset=int(offsets[0]))
        self.starts = (offsets[:-1] - offsets[0]).astype(np.int64)
        self.ends = (offsets[1:] - offsets[0]).astype(np.int64)
        # Rows of equal ids are one owner: neither is the smaller document.
        ids = batch.column("_id")
        self.owner = np.zeros(len(ids), np.int64)
        if len(ids):
            values, nulls = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
            self.owner[1:] = np.cumsum((values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1]))

    @cached_property
    def words(self) -> np.ndarray:
        return words_of(self.data)

    def keys(self, at: np.ndarray, length: int, bits: int, odd: np.ndarray) -> np.ndarray:
        return keys_at(self.data, at, length, bits, odd, self.words if len(at) * length > len(self.data) else None)

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def rows_in_order(self, at: np.ndarray) -> np.ndarray:
        """``rows_of`` positions that ascend."""
        bounds = np.append(np.searchsorted(at, self.starts), len(at))
        return np.repeat(np.arange(len(self.starts)), np.diff(bounds))

    def sample_counts(self) -> None:
        """How many positions of the cover sample each document has, and the numbers of the first ones."""
        sizes = np.maximum(self.ends - self.starts - (self.length - PERIOD), 0)
        self.counts = sizes // PERIOD * len(COVER) + np.searchsorted(np.array(COVER), sizes % PERIOD)
        self.firsts = np.cumsum(self.counts) - self.counts
        number = np.arange(self.counts.max(initial=0))
        self.offsets = number // len(COVER) * PERIOD + np.array(COVER)[number % len(COVER)]

    def samples(self) -> None:
        """The cover sample's positions, counted from each document's start, and keys."""
        self.sample_counts()
        self.sample_row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.sample_at = self.offsets[np.arange(len(self.sample_row)) - np.repeat(self.firsts, self.counts)] + np.repeat(self.starts, self.counts)
        self.sample_keys = self.keys(self.sample_at, self.length - PERIOD + 1, self.how.sample_bits, self.odd)

    def shared(self, elsewhere: np.ndarray) -> bytes:
        """Packed bits of the samples that another document has: in another chunk (``elsewhere``) or here."""
        self.samples()
        return np.packbits(later_copies(self.sample_keys, self.owner[self.sample_row], True, elsewhere)).tobytes()

    def keep(self, bits: bytes) -> None:
        """Keeps the samples that ``shared`` tells, and takes the keys of their long ties."""
        self.sample_counts()
        kept = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(self.counts.sum())))
        # An empty document has the number of the next one's first sample, so the last of equal numbers is meant.
        self.sample_row = np.searchsorted(self.firsts, kept, side="right") - 1
        self.sample_at = self.offsets[kept - self.firsts[self.sample_row]] + self.starts[self.sample_row]
        self.long = self.sample_at + self.length + PERIOD - 1 <= self.ends[self.sample_row]
        self.long_keys = self.keys(self.sample_at[self.long], self.length + PERIOD - 1, self.how.key_bits, self.odd)

    def resolve(self, earlier: np.ndarray) -> None:
        """Marks the suffixes that long ties with earlier documents resolve; lists the other ones
        that share a sample, with their keys."""
        self.tied = tied = later_copies(self.long_keys, self.owner[self.sample_row[self.long]], False, earlier)
        at = self.sample_at[self.long][tied]
        self.resolved = cover(len(self.data), at, at + PERIOD)
        low = np.maximum(self.sample_at - PERIOD + 1, self.starts[self.sample_row])
        high = np.minimum(self.sample_at + 1, self.ends[self.sample_row] - self.length + 1)
        good = low < high
        self.near = cover(len(self.data), low[good], high[good])
        self.rest = np.flatnonzero(self.near & ~self.resolved)
        self.rest_keys = self.keys(self.rest, self.length, self.how.key_bits, self.odd)

    def look_at(self, look: Look) -> None:
        """Lists the positions of strings in doubt, with their keys by the look's hash function."""
        at = np.flatnonzero(self.near | self.resolved)
        keys = self.keys(at, self.length, KEY_BITS, factors(look.seed))
        here = member(keys, look.wanted)
        self.look_places, self.look_keys = at[here], keys[here]

    def removed(self, earlier: np.ndarray, looks: list[tuple[Look, np.ndarray]] = ()) -> np.ndarray:
        """Which bytes go. For each look there are the keys that earlier chunks have; what a look is
        about isn't settled by anything before it."""
        self.again = later_copies(self.rest_keys, self.owner[self.rows_in_order(self.rest)], False, earlier)
        self.looks = []
        gone, doubted = self.resolved.copy(), np.zeros(len(self.data), bool)
        gone[self.rest[self.again]] = True
        for look, have in looks:
            self.look_at(look)
            claimed = later_copies(self.look_keys, self.owner[self.rows_in_order(self.look_places)], False, have)
            gone[self.look_places] = False
            gone[self.look_places[claimed]] = True
            doubted[self.look_places] = True
            for _, places, mine in self.looks:
                mine &= ~np.isin(places, self.look_places)
            self.looks.append((self.look_keys, self.look_places, claimed))
        if looks:
            # Claims on strings that a look is about count no more: a long tie's, if all of its strings are.
            ties = self.sample_at[self.long]
            run = np.concatenate([[0], np.cumsum(doubted)])
            self.tied = self.tied & (run[np.minimum(ties + PERIOD, len(doubted))] - run[ties] < PERIOD)
            self.again = self.again & ~doubted[self.rest]
        starts = np.flatnonzero(gone)
        return cover(len(self.data), starts, starts + self.length)

    def kinds(self) -> list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """Of long ties, the rest and each look: keys, positions, the length that a key stands for, and
        which are claimed."""
        first = [(self.long_keys, self.sample_at[self.long], self.length + PERIOD - 1, self.tied), (self.rest_keys, self.rest, self.length, self.again)]
        return first + [(keys, places, self.length, claimed) for keys, places, claimed in self.looks]

    def claims(self, known: list[tuple[np.ndarray, np.ndarray]], seed: int, since: int = 0) -> tuple[np.ndarray, list[tuple[int, bytes, bytes, bytes]]]:
        """The strings of claims within the chunk that fail, as keys for a look of that seed, and the
        claims on other chunks: a chunk, pieces of text one after the other, positions in them, and
        their kinds. ``known``: by kind the keys that earlier chunks have, ascending, and the first chunk
        that has each. Kinds before ``since`` have been checked."""
        wrong, at, size, first, kind = [np.zeros(0, np.uint64)], [], [], [], []
        for number, ((keys, places, length, claimed), (there, where)) in enumerate(zip(self.kinds(), known, strict=True)):
            own = np.flatnonzero(claimed)
            if number < since or not len(own):
                continue
            index = find(keys[own], there)
            outside = index >= 0
            inside = own[~outside]
            if len(inside):
                some = np.flatnonzero(member(keys, distinct(np.sort(keys[inside]))))
                first_one = some[first_of(keys[some], self.owner[self.rows_of(places[some])])]
                at_first = first_one[np.searchsorted(some, inside)]
                bad = differ(self.data, places[inside], self.data, places[at_first], length)
                wrong.append(doubts(self.data, places[inside][bad], length - self.length + 1, self.length, seed))
            own = own[outside]
            at.append(places[own])
            size.append(np.full(len(own), length))
            first.append(where[index[outside]])
            kind.append(np.full(len(own), number))
        wrong = np.unique(np.concatenate(wrong))
        if not sum(map(len, at)):
            return wrong, []
        p, n, f, q = (np.concatenate(x) for x in (at, size, first, kind))
        order = np.lexsort((p, f))
        p, n, f, q = p[order], n[order], f[order], q[order]
        fresh = np.concatenate([[True], f[1:] != f[:-1]])
        # Claims that overlap are one piece: ends so far, each chunk's beyond all of the one before.
        shift = (np.cumsum(fresh) - 1) * (len(self.data) + 1)
        ends = np.maximum.accumulate(p + n + shift)
        begins = np.flatnonzero(np.concatenate([[True], (p + shift)[1:] > ends[:-1]]))
        piece = np.cumsum(np.isin(np.arange(len(p)), begins)) - 1
        low = p[begins]
        lengths = ends[np.append(begins[1:], len(p)) - 1] - shift[begins] - low
        before = np.cumsum(lengths) - lengths
        text = self.data[np.arange(lengths.sum()) + np.repeat(low - before, lengths)]
        out, bounds = [], np.append(np.flatnonzero(fresh), len(p))
        for a, b in zip(bounds, bounds[1:], strict=False):
            start, stop = before[piece[a]], before[piece[b - 1]] + lengths[piece[b - 1]]
            places = (p[a:b] - low[piece[a:b]] + before[piece[a:b]] - start).astype("<i8")
            out.append((int(f[a]), text[start:stop].tobytes(), places.tobytes(), q[a:b].astype("<u2").tobytes()))
        return wrong, out

    def marks(self) -> bytes:
        """The positions of each kind, as packed bits."""
        kinds = self.kinds()
        bits = np.zeros((len(kinds), len(self.data)), bool)
        for row, (_, places, _, _) in zip(bits, kinds, strict=True):
            row[places] = True
        return np.packbits(bits).tobytes()

    def refute(self, claims: list[dict], marks: bytes, looks: list[Look], seed: int) -> np.ndarray:
        """The strings of claims of other chunks that fail here, as keys for a look of that seed; all
        claims are looked up at once. ``marks`` spare finding the positions again."""
        count = 2 + len(looks)
        words = None
        bits = np.unpackbits(np.frombuffer(marks, np.uint8), count=count * len(self.data)).reshape(count, -1)
        sizes = [len(x["text"]) for x in claims]
        text = np.zeros(sum(sizes) + 8, np.uint8)
        text[:-8] = np.frombuffer(b"".join(x["text"] for x in claims), np.uint8)
        before = np.cumsum([0, *sizes[:-1]])
        at = np.concatenate([np.frombuffer(x["at"], "<i8") + n for x, n in zip(claims, before, strict=True)])
        kind, wrong = np.frombuffer(b"".join(x["kind"] for x in claims), "<u2"), [np.zeros(0, np.uint64)]
        hashes = [(self.how.key_bits, self.odd)] * 2 + [(KEY_BITS, factors(look.seed)) for look in looks]
        for number, (row, (width, odd)) in enumerate(zip(bits, hashes, strict=True)):
            some, length = at[kind == number], self.length + PERIOD - 1 if number == 0 else self.length
            if not len(some):
                continue
            words = words_of(text) if words is None else words
            asked, places = keys_at(text, some, length, width, odd, words), np.flatnonzero(row)
            keys = self.keys(places, length, width, odd)
            kept = member(keys, distinct(np.sort(asked)))
            keys, places = keys[kept], places[kept]
            # Of equal keys the first position answers, in each call the same one.
            order = np.argsort(keys)
            own, first = keys[order], places[order]
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            own, first = own[begins], np.minimum.reduceat(first, begins) if len(own) else first
            index = find(asked, own)
            bad = index < 0
            good = np.flatnonzero(~bad)
            bad[good] = differ(text, some[good], self.data, first[index[good]], length)
            wrong.append(doubts(text, some[bad], length - self.length + 1, self.length, seed))
        return np.unique(np.concatenate(wrong))


def cover(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """True from each low up to its high, not included, in an array of ``n``; lows ascend, and highs too."""
    steps = np.zeros(n + 1, np.int8)
    if len(low):
        begins = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
        steps[low[begins]] = 1
        steps[high[np.append(begins[1:], len(high)) - 1]] = -1
    return np.cumsum(steps[:n], dtype=np.int8).view(bool)


@dataclass
class Chunked:
    """The chunks as a table ``chunk``, ``data`` (an Arrow batch), and the total of bytes and chunks."""

    table: DataFrame
    bytes: int
    chunks: int


def make_chunks(df: DataFrame, id_col: str, text_col: str, carry: list[str], chunk_bytes: int) -> Chunked:
    """Chunks of ``df`` in ascending order of id (null first), then text; equal ids share a chunk."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = total // (4 * chunk_bytes) + 1
    rows = rows.repartitionByRange(ranges, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "text")
    rows = rows.withColumn("_part", F.spark_partition_id())

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0
        last: tuple | None = None

        def flush() -> pa.RecordBatch:
            nonlocal number
            part = held[0].column("_part")[0].as_py()
            whole = pa.Table.from_batches(held).drop_columns(["_part"]).combine_chunks()
            batch = whole.to_batches()[0]
            if batch.num_rows != whole.num_rows:
                raise ValueError("a chunk's texts have over two billion bytes")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            number += 1
            return pa.record_batch([pa.array([(part << 32) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("_id").to_pylist()
            sizes = np.asarray(pa.compute.binary_length(batch.column("text"))).astype(np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(ids):
                if held and size >= chunk_bytes and (ids[at],) != last:
                    yield flush()
                    held, size = [], 0
                # As many rows as fill the chunk, and on to the end of a run of equal ids.
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + chunk_bytes - size)) + 1)
                while stop < len(ids) and ids[stop] == ids[stop - 1]:
                    stop += 1
                stop = min(stop, len(ids))
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                last, at = (ids[stop - 1],), stop
        if held:
            yield flush()

    chunks = rows.mapInArrow(chunk, "chunk long, data binary")
    place = shared_path(spark, "text-chunks")
    name = "millrace_" + place.rpartition("-")[2]
    # Bucketed by chunk, as many buckets as a shuffle has partitions: each pass joins what it got for
    # the chunks without shuffling the texts again.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = chunks.write.option("path", place).option("compression", "none").bucketBy(width, "chunk").sortBy("chunk")
    writer.saveAsTable(name)
    del chunks, writer, rows
    let_go(spark)
    table = spark.table(name)
    # The frame has its files and buckets; the catalog needn't keep the name.
    spark.sql(f"DROP TABLE {name}")
    return Chunked(table, total, table.select("chunk").count())


def open_chunk(data: bytes, how: Hashing) -> Chunk:
    with pa.ipc.open_stream(pa.py_buffer(data)) as source:
        return Chunk(source.read_next_batch(), how)


def bucket_rows(chunk: int, keys: np.ndarray, bits: int, buckets: int, part: range) -> list[tuple]:
    """Rows bucket, chunk, keys of a chunk's distinct keys, cut into ranges of equal width, for the
    buckets of ``part``."""
    keys = distinct(np.sort(keys))
    edges = np.array([((1 << bits) * b) // buckets for b in range(1, buckets)], np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(b, chunk, pack(keys[at[b] : at[b + 1]])) for b in part if at[b] < at[b + 1]]


KEY_ROWS = "bucket long, chunk long, keys binary"


def key_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "chunk", "keys"])


def in_order(keys: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and owners, of ``width`` bits, by key and then owner.

    Both go into one number, as a plain sort is several times as fast as a sort of places; keys of
    too wide a range are halved."""
    if not len(keys):
        return keys, owners
    least, most = keys.min(), keys.max()
    bits = int(most - least).bit_length()
    if bits + width > 64:
        low = keys < least + np.uint64(1 << (bits - 1))
        halves = [in_order(keys[x], owners[x], width) for x in (low, ~low)]
        return np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves])
    both = (keys - least) << np.uint64(width)
    both |= owners
    both.sort()
    owners = both & np.uint64((1 << width) - 1)
    both >>= np.uint64(width)
    both += least
    return both, owners


def shared_keys(keys: np.ndarray, sizes: list[int], every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the keys of several owners, so many each and distinct, those that an earlier owner has (with
    ``every``, another one), by owner and ascending: the keys, their owners and the first owners."""
    owners = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    k, o = in_order(keys, owners, max(1, (len(sizes) - 1).bit_length()))
    copy = np.zeros(len(k), bool)
    copy[1:] = k[1:] == k[:-1]
    kept = copy.copy()
    if every:
        kept[:-1] |= copy[1:]
    kept = np.flatnonzero(kept)
    first = o[np.flatnonzero(~copy)[np.cumsum(~copy)[kept] - 1]].astype(np.int64)
    k, o = k[kept], o[kept].astype(np.int64)
    order = np.argsort(o.astype(np.uint16) if len(sizes) < 1 << 16 else o, kind="stable")
    return k[order], o[order], first[order]


def sort_buckets(rows: DataFrame, every: bool) -> DataFrame:
    """chunk, keys, firsts: the keys of each chunk that an earlier chunk has (with ``every``, another
    one), and the first chunk that has each, one bucket sorted at a time."""

    def sort(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["chunk"]), kind="stable")
        table = table.take(pa.array(order))
        chunks = np.asarray(table["chunk"])
        each = [unpack(x.as_py()) for x in table["keys"]]
        sizes = [len(x) for x in each]
        keys, owners, firsts = shared_keys(np.concatenate(each), sizes, every)
        del each
        out, at = [], np.searchsorted(owners, np.arange(len(sizes) + 1))
        for c, a, b in zip(chunks.tolist(), at, at[1:], strict=False):
            if a < b:
                out.append((c, pack(keys[a:b]), None if every else chunks[firsts[a:b]].astype("<i8").tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["chunk", "keys", "firsts"])

    return rows.groupBy("bucket").applyInArrow(sort, "chunk long, keys binary, firsts binary")


def with_found(chunks: DataFrame, found: list[tuple[int, DataFrame]]) -> DataFrame:
    """``chunks`` with a column of what was found for them: structs of the pass, keys and firsts.

    One join, and the chunks' table is bucketed as the found keys are dealt, so it isn't shuffled."""
    kind = "array<struct<pass:int,keys:binary,firsts:binary>>"
    if not found:
        return chunks.withColumn("found", F.array().cast(kind))
    tagged = [rows.select("chunk", F.struct(F.lit(i).alias("pass"), "keys", "firsts").alias("f")) for i, rows in found]
    lists = reduce(DataFrame.unionByName, tagged).groupBy("chunk").agg(F.collect_list("f").alias("found"))
    return chunks.join(lists, "chunk", "left")


def keys_of(found, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a pass found for a chunk, ascending, and their first chunks: buckets are ranges,
    but come in any order."""
    some = sorted(((unpack(x["keys"]), x["firsts"] or b"") for x in found.as_py() or () if x["pass"] == number), key=lambda x: int(x[0][0]))
    if not some:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in some]), np.concatenate([np.frombuffer(x[1], "<i8") for x in some])


CLAIM_ROWS = "chunk long, wrong array<long>, gone binary, marks binary, of long, text binary, at binary, kind binary"


def claim_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in CLAIM_ROWS.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


class Looks(list):
    """The looks so far, and what the sorts before them found, which further looks need: the chunks with
    their shared samples, the keys found by each pass, and the bits of all chunks by the last look.
    With ``whole`` there were more strings in doubt than a look takes: all claims are checked again."""

    def __init__(self) -> None:
        super().__init__()
        self.base: DataFrame | None = None
        self.found: list[tuple[int, DataFrame]] = []
        self.gone: DataFrame | None = None
        self.whole = True
        self.scratch: list[DataFrame] = []


def dealt(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """``chunks`` with lists of the claims on them. A chunk that many others copy from gets its claims
    in several lists, which are dealt by chunk and list, so that they need not meet in a task; chunks
    of a single list aren't shuffled."""
    asked = asked.select("of", F.struct("text", "at", "kind").alias("c"), F.xxhash64("chunk", "of").alias("h")).withColumnRenamed("of", "chunk")
    lists = asked.groupBy("chunk").agg(F.ceil(F.sum(F.octet_length("c.text")) / CLAIM_BYTES).alias("lists"))
    asked = asked.join(lists, "chunk").groupBy("chunk", F.pmod("h", "lists").alias("list"), "lists").agg(F.collect_list("c").alias("claims"))
    few = chunks.join(asked.where("lists <= 1").drop("list", "lists"), "chunk")
    copies = chunks.join(lists.where("lists > 1"), "chunk").withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1))).drop("lists")
    return few.unionByName(copies.join(asked.where("lists > 1").drop("lists"), ["chunk", "list"]).drop("list"))


def settled(chunks: Chunked, how: Hashing, bucket_keys: int, looks: Looks | None = None) -> DataFrame | None:
    """chunk, gone: the packed bits of the bytes that go, after the three sorts and a sort for each look;
    None if some keys were equal by chance. Then ``looks`` has one more, for the strings in doubt, and
    the next call sorts only them, and works only on chunks that have them."""
    spark = chunks.table.sparkSession
    looks = Looks() if looks is None else looks
    old, seed = list(looks), how.seed + 1 + len(looks)
    buckets = chunks.bytes * len(COVER) // PERIOD // bucket_keys + 1

    def opened(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[tuple]:
        """Chunks by name, as far as ``passes`` earlier passes settle them, and their rows."""
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                chunk = open_chunk(row["data"].as_py(), how)
                if passes > 0:
                    chunk.keep(row["kept"].as_py())
                if passes > 1:
                    chunk.resolve(keys_of(row["found"], 1)[0])
                yield row["chunk"].as_py(), chunk, row

    # What a pass sorts: the keys' name, their bits, and in how many parts, one after the other.
    # Rest keys are the most; their parts bound the disk that a shuffle takes.
    passes = [("sample_keys", how.sample_bits, 1), ("long_keys", how.key_bits, 1), ("rest_keys", how.key_bits, REST_PARTS), *[("look_keys", KEY_BITS, 1)] * len(old)]

    def keys_to_sort(number: int, part: range) -> Callable:
        name, width, _ = passes[number]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk_name, chunk, _ in opened(batches, number):
                if number == 0:
                    chunk.samples()
                if number > 2:
                    chunk.look_at(old[number - 3])
                yield key_batch(bucket_rows(chunk_name, getattr(chunk, name), width, buckets, part))

        return send

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = pa.list_(pa.struct({"bucket": pa.int64(), "keys": pa.binary()}))
        for name, chunk, row in opened(batches, 0):
            kept = chunk.shared(keys_of(row["found"], 0)[0])
            chunk.keep(kept)
            rows = [{"bucket": b, "keys": keys} for b, _, keys in bucket_rows(name, chunk.long_keys, how.key_bits, buckets, range(buckets))]
            yield pa.record_batch([pa.array([name], pa.int64()), pa.array([kept], pa.binary()), pa.array([rows], long)], ["chunk", "kept", "long"])

    # Claims of the sorts, and of earlier looks, have been checked before a further look.
    since = 0 if looks.whole else 1 + len(old)

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk, row in opened(batches, 2):
            known = [keys_of(row["found"], 1 + k) for k in range(2 + len(old))]
            gone = chunk.removed(known[1][0], [(look, have[0]) for look, have in zip(old, known[2:], strict=True)])
            wrong, claims = chunk.claims(known, seed, since)
            whole = (name, wrong.view(np.int64).tolist(), np.packbits(gone).tobytes(), chunk.marks(), None, None, None, None)
            yield claim_batch([whole, *((name, None, None, None, *some) for some in claims)])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, row in opened(batches, 0):
            wrong = chunk.refute(row["claims"].as_py(), row["marks"].as_py(), old, seed)
            yield pa.record_batch([pa.array([wrong.view(np.int64).tolist()], pa.list_(pa.int64()))], ["wrong"])

    base, touched = looks.base or chunks.table, None
    for number, (name, _, parts) in enumerate(passes):
        if looks.base and number < len(passes) - 1:
            continue
        own = []
        for k in range(parts):
            part = range(buckets * k // parts, buckets * (k + 1) // parts)
            if number == 1:
                rows = shared.select("chunk", F.explode("long").alias("row")).select("row.bucket", "chunk", "row.keys")
            else:
                rows = with_found(base, looks.found).mapInArrow(keys_to_sort(number, part), KEY_ROWS)
            if number > 2:
                # Keys of strings in doubt are few; the chunks that have them are all that changes.
                rows = stored(rows, name)
                looks.scratch.append(rows)
                touched = rows.select("chunk").distinct()
            own.append((number, stored(sort_buckets(rows, every=number == 0), f"shared-{name}")))
            del rows
            let_go(spark)
        looks.found += own
        if number == 0:
            # Which samples are shared is told once, as bits, with the keys of long ties; later passes
            # needn't sort samples again.
            marked = with_found(base, looks.found).mapInArrow(mark, "chunk long, kept binary, long array<struct<bucket:bigint,keys:binary>>")
            shared = stored(marked, "shared-samples")
            del marked
            forget(looks.found.pop()[1])
            looks.scratch.append(shared)
            base = chunks.table.join(shared.select("chunk", "kept"), "chunk")
    looks.base = base
    some = base if touched is None or looks.whole else base.join(touched, "chunk", "left_semi")
    claims = stored(with_found(some, looks.found).mapInArrow(claim, CLAIM_ROWS), "claims")
    new = claims.where("of is null")
    wrong = dealt(chunks.table.join(new.select("chunk", "marks"), "chunk"), claims.where("of is not null")).mapInArrow(check, "wrong array<long>")
    wrong = wrong.unionByName(claims.where("size(wrong) > 0").select("wrong")).select(F.explode("wrong").alias("key")).distinct()
    # Any of the strings in doubt will do: those beyond the bound fail again, and the next look is theirs.
    found_wrong = wrong.limit(MOST_DOUBTS).toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64)
    gone = new.select("chunk", "gone")
    looks.gone = gone if some is base else gone.unionByName(looks.gone.join(new.select("chunk"), "chunk", "left_anti"))
    looks.whole = len(found_wrong) >= MOST_DOUBTS
    if len(found_wrong):
        let_go(spark)
        looks.append(Look(seed, np.sort(found_wrong)))
        return None
    for rows in (*looks.scratch, *(rows for _, rows in looks.found)):
        forget(rows)
    let_go(spark)
    return looks.gone


def dedup(
    df: DataFrame, id_col: str, text_col: str, carry: list[str], length: int, finish: Callable, schema: str,
    chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS, key_bits: int = KEY_BITS, sample_bits: int | None = None,
) -> DataFrame:
    """``finish`` (a chunk, the mask of its bytes that go) for every chunk."""
    chunks = make_chunks(df, id_col, text_col, carry, chunk_bytes)
    samples = chunks.bytes * len(COVER) // PERIOD
    sample_bits = sample_bits or min(KEY_BITS, max(32, samples.bit_length() + SPARE_BITS))
    how, looks = Hashing(length, sample_bits, key_bits, 50), Looks()
    gone = settled(chunks, how, bucket_keys, looks)
    while gone is None:
        gone = settled(chunks, how, bucket_keys, looks)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bits in zip(batch.column("data"), batch.column("gone"), strict=True):
                chunk = open_chunk(data.as_py(), how)
                yield finish(chunk, np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(chunk.data)).view(bool))

    return chunks.table.join(gone, "chunk").select("data", "gone").mapInArrow(last, schema)


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    Null is the empty text; texts shorter than ``length`` lose nothing. A null id is smaller than
    any other; among rows with equal ids none is smaller. A string that repeats inside one document
    stays. Extra columns are left behind; an empty table gives an empty result.
    """

    def digest(chunk: Chunk, gone: np.ndarray) -> pa.RecordBatch:
        out = []
        for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            own, mask = chunk.data[a:b], gone[a:b]
            n = int(mask.sum())
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if n else 0
            out.append((b - a, n, spans, hashlib.sha256((own[~mask] if n else own).tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        return pa.record_batch([chunk.batch.column("_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return dedup(df, id_col, text_col, [], length, digest, schema, **sizes)


def without_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """``df`` with the repeated strings cut out of its texts; all its rows and columns stay.

    A character goes if all its bytes do, so texts stay valid. Null texts stay null, and an
    ``n_chars`` column follows its text."""
    names = df.columns

    def cut(chunk: Chunk, gone: np.ndarray) -> pa.RecordBatch:
        # A character's bytes go together: a kept byte keeps its whole character.
        tail = (chunk.data & 0xC0) == 0x80
        head = np.maximum.accumulate(np.where(tail, 0, np.arange(len(tail))))
        kept = np.zeros(len(tail), bool)
        kept[head[~gone]] = True
        kept = kept[head]
        texts = [chunk.data[a:b][kept[a:b]].tobytes() for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)]
        new = pa.array(texts, pa.binary()).cast(pa.string())
        columns = []
        for i, name in enumerate(names):
            old = chunk.batch.column(f"_{i}")
            if name == text_col:
                columns.append(pa.compute.if_else(chunk.batch.column("_null"), pa.scalar(None, pa.string()), new))
            elif name == "n_chars":
                columns.append(pa.compute.if_else(chunk.batch.column("_null"), old, pa.compute.utf8_length(new).cast(old.type)))
            else:
                columns.append(old)
        return pa.record_batch(columns, [f"c{i}" for i in range(len(names))])

    # The text itself travels once: its place among the carried columns holds a null.
    carried = df.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"c{i}") if c != text_col else F.lit(None).cast("string").alias(f"c{i}") for i, c in enumerate(names)), F.col(text_col).isNull().alias("_null"))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))

    def renamed(chunk: Chunk, gone: np.ndarray) -> pa.RecordBatch:
        n = len(names)
        chunk.batch = chunk.batch.rename_columns(["_id", "text", *(f"_{i}" for i in range(n)), "_null"])
        return cut(chunk, gone)

    out = dedup(carried, "_key", "_text", [*(f"c{i}" for i in range(len(names))), "_null"], length, renamed, schema, **sizes)
    return out.toDF(*names)
