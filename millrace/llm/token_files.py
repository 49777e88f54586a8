"""Token ids in files: frequency ranks, coded in one to four bytes with separate control bytes.

The files are Parquet tables, so Spark writes and reads them on any store. A row is a block: whole
documents in ascending id order, their ids and token counts, and the tokens' ranks coded as a
stream of control bytes (two bits a value: its length in bytes less one, four values a byte) and a
stream of data bytes (little endian). Rank 0 is the most frequent id of the corpus, so most values
take one byte. Blocks carry how many tokens of their part come before them; readers can decode any
block alone, by numpy table lookup.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import forget, shared_path, stored

BLOCK_TOKENS = 1 << 18
#: Bytes of ids that a range holds, about; smaller tables are cut for all cores, but not below so many rows.
RANGE_BYTES, LEAST_ROWS = 32 << 20, 1000
#: Words whose ids a task remembers at once, and the text it works on at once.
CACHE_WORDS, CHUNK_CHARS = 700_000, 4_000_000

CODED = "part int, block int, before long, n long, doc_ids binary, lengths binary, control binary, data binary"

#: Lengths of the four values of a control byte, by the byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4", copy=False)
    extra = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    planes = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), planes[np.arange(4) <= extra[:, None]].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of two streams: lengths by table lookup, then a gather for each byte."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    ends = np.cumsum(lengths)
    starts, source = ends - lengths, np.frombuffer(data, np.uint8)
    out = source[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= source[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Texts of these characters alone are cut at white space and encoded word by word: for them the
#: library's white space is this one, and no character of one word changes another.
PLAIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u02af]*")
#: Signs behind a letter or digit that end a word. They are a piece of their own in any case, so
#: they are cut off first: "word," and "word." need not both be remembered.
TAIL = r"([\pL\pN])([!-&(-/:-@\[-`{-~]+(?:[\t-\r ]|$))"
#: New words that are encoded as one text.
JOINED = 200
# The normalizer and the end of a word for which words may be encoded one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
END_OF_WORD = "</w>"

_known: dict[str, dict[str, bytes]] = {}


class WordIds:
    """Ids of texts by a tokenizer file.

    If the file's normalizer is ``NORMALIZER``, its words are pieces of one pattern that never holds
    white space, and each piece ends with a token of ``END_OF_WORD``, then the words of a plain text
    are encoded when first met, ``JOINED`` at a time, and remembered by the worker, also for its
    later tasks, up to ``CACHE_WORDS`` words. Other texts, those that hold one of the file's added
    tokens in any letter case, and all texts for another kind of file go to the library as they are.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if max(vocabulary.values(), default=0) < 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.piece = piece_pattern(spec)
        if self.piece is None:
            return
        self.added = [t["content"].lower() for t in spec["added_tokens"]]
        # Plain words come in lower case and between single blanks: normalizing changes nothing.
        self.plain_tokenizer = Tokenizer.from_file(path)
        self.plain_tokenizer.normalizer = normalizers.Sequence([])
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True
        self.known = _known.setdefault(path, {})

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            found = self.plain_tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(found.ids, self.kind)
            cuts = np.flatnonzero(self.closes[ids]) + 1
            pieces = np.cumsum([1 if w.isalpha() else len(self.piece.findall(w)) for w in some])
            if len(cuts) != pieces[-1] or (cuts[-1] if len(cuts) else 0) != len(ids):
                # The library cuts some word in another way: each by itself, then.
                self.known.update(zip(some, self.whole(some), strict=True))
                continue
            data = ids.tobytes()
            ends = (self.kind.itemsize * np.concatenate([[0], cuts])[pieces]).tolist()
            self.known.update((w, data[a:b]) for w, a, b in zip(some, [0, *ends], ends, strict=False))

    def is_plain(self, text: str) -> bool:
        if PLAIN.fullmatch(text) is None:
            return False
        low = text.lower()
        return not any(t in low for t in self.added)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian bytes."""
        out = []
        for some in chunks(texts):
            plain = [self.piece is not None and self.is_plain(t) for t in some]
            coded = iter(self.plain([t.lower() for t, p in zip(some, plain, strict=True) if p]))
            other = iter(self.whole([t for t, p in zip(some, plain, strict=True) if not p]))
            out += [next(coded) if p else next(other) + self.end for p in plain]
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """The same of lower-case plain texts: each distinct word is looked up once, and the ids are
        gathered by numpy."""
        if not texts:
            return []
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pa.array(texts, pa.string()), TAIL, r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, each, strict=True) if ids is None]
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                # What these texts have of the known words is most of what texts have often.
                kept = [(w, ids) for w, ids in zip(words, each, strict=True) if ids is not None]
                self.known.clear()
                self.known.update(kept)
            self.learn(new)
            each = [self.known[w] if ids is None else ids for w, ids in zip(words, each, strict=True)]
        size = self.kind.itemsize
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // size
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(each), self.kind)
        which = np.asarray(coded.indices)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + lengths, lengths)]
        offsets = np.asarray(split.offsets)
        cuts = (size * np.concatenate([[0], ends])[offsets - offsets[0]]).tolist()
        data = ids.tobytes()
        return [data[a:b] + self.end for a, b in zip(cuts, cuts[1:], strict=False)]


def piece_pattern(spec: dict) -> regex.Pattern | None:
    """How a tokenizer file of the kind that ``WordIds`` knows cuts a word; None for other kinds."""
    model, cut = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = (
        spec.get("normalizer") == NORMALIZER
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == END_OF_WORD
        and not (model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges"))
        and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
        and (cut[0].get("behavior"), cut[0].get("invert")) == ("Removed", True)
        and not (cut[1].get("add_prefix_space") or cut[1].get("use_regex"))
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )
    pattern = cut[0].get("pattern", {}).get("Regex", "") if known else ""
    # Of the pieces' pattern only this one is known to give signs behind a letter a piece of their own.
    return regex.compile(pattern) if pattern == PIECE else None


# Fixed value: how a word is cut into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about ``CHUNK_CHARS`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoded_texts(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian bytes, the end id last), a row per row, encoded where rows lie."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(path, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                yield pa.record_batch([some.column(0), pa.array(ids_of(some.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(encode, "doc_id long, ids binary")


def coded_blocks(encoded: DataFrame, wide: bool, rank: np.ndarray) -> DataFrame:
    """Blocks in ascending order of doc_id (null first), then ids: a range of rows is a part, cut
    into blocks. Rows of equal doc_id may lie in several ranges."""
    spark, size = encoded.sparkSession, 4 if wide else 2
    totals = encoded.agg(F.sum(F.octet_length("ids")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    few = min(totals["n"] // LEAST_ROWS + 1, 2 * spark.sparkContext.defaultParallelism)
    ranges = max((totals["bytes"] or 0) // RANGE_BYTES + 1, few)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("ids")]
    rows = encoded.select("doc_id", F.xxhash64("ids").alias("tie"), "ids")
    rows = rows.repartitionByRange(ranges, *order[:2]).sortWithinPartitions(*order)
    rows = rows.select("doc_id", "ids", F.spark_partition_id().alias("part"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, schema = np.dtype(f"<u{size}"), arrow_schema(CODED)
        ids: list[bytes] = []
        docs: list[int | None] = []
        part = block = before = held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // size for x in ids], "<u4")
            keys = np.array([NO_ID if d is None else d for d in docs], "<i8")
            streams = encode_values(rank[np.frombuffer(b"".join(ids), kind)])
            row = [part, block, before, held, keys.tobytes(), lengths.tobytes(), *streams]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(x)
                docs.append(key)
                held += len(x) // size
                if held >= BLOCK_TOKENS:
                    yield flush()
                    block, before, held, ids, docs = block + 1, before + held, 0, [], []
        if ids:
            yield flush()

    return rows.mapInArrow(blocks, CODED)


#: Stands for a null id in a block's binary ids.
NO_ID = -(1 << 63)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def frequency_order(encoded: DataFrame, wide: bool) -> np.ndarray:
    """The ids of all texts, most frequent first, ties by id. There are no more rows than ids."""
    kind = "<u4" if wide else "<u2"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                got = np.bincount(np.frombuffer(x.as_py(), kind))
                if len(got) > len(total):
                    got, total = total, got
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(((-r["n"], r["id"]) for r in counts.collect()))
    return np.array([r[1] for r in rows], np.uint32)


def write_token_files(df: DataFrame, path: str, end_id: int, to: str | None = None, **columns: str) -> tuple[str, np.ndarray]:
    """Encodes every text with the tokenizer file at ``path``, appends ``end_id`` to each, and
    writes the files below ``to`` (or a new shared folder). Returns the place and the ids by rank.

    Null is the empty text; repeated ids stay, in the order of a hash of their tokens; a null id comes first.
    """
    from tokenizers import Tokenizer

    spark = df.sparkSession
    wide = max(Tokenizer.from_file(path).get_vocab().values(), default=0) >= 1 << 16
    encoded = stored(encoded_texts(df, path, end_id, **columns), "token-ids", "lz4")
    order = frequency_order(encoded, wide)
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    to = to or shared_path(spark, "token-files")
    coded_blocks(encoded, wide, rank).write.option("compression", "none").parquet(to)
    forget(encoded)
    return to, order


def read_token_files(spark: SparkSession, place: str, order: np.ndarray) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(place)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    back = order

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("part int, doc_id long, start long, n_tokens long, ids_crc32 long")
        for batch in batches:
            for row in batch.to_pylist():
                ids = back[decode_values(row["control"], row["data"], row["n"])].astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                keys = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(keys), row["part"], np.int32)),
                        pa.array(keys, mask=keys == NO_ID),
                        pa.array(row["before"] + ends - lengths),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    schema=schema,
                )

    rows = blocks.mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = rows.join(parts, "part")
    return rows.select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
