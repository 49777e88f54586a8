"""Periodic runs of words: found by Lyndon arrays in two orders of the alphabet, and collapsed.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run has
a root, the longest Lyndon word at one of its positions, in an order of the words or in its reverse
(the runs theorem). Ellert and Fischer find all roots and how far each is repeated on ordered
alphabets in linear time, by comparing words only: the longest Lyndon word at i ends before the next
smaller suffix, and each suffix is held against the chain of previous smaller suffixes. What was
matched before is used again: inside the stretch that was matched furthest, pairs of suffixes agree
as far as their copies did, and along the chain the smaller of two known extensions counts. Words
are only read anew beyond that stretch, so all matches together are linear. No suffix array or tree
is built and no hash of a stretch is taken; words are named by numbers, whose order is free.

Before that a test rules out stretches that hold no run: in a run with period q, of the least
exponent e, all words but the last q recur within q words, so a stretch whose words recur only at
more than its length / (e - 1) words ends there. It is exact and works on arrays; ordinary prose
ends with it, and what is left goes through the algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import words

Run = tuple[int, int, int]
#: Texts whose results are held at once.
BATCH = 256


def lyndon_array(codes: list[int]) -> tuple[list[int], list[int]]:
    """For each position the next smaller suffix (the length, if there is none) and how many codes
    the two suffixes share; a proper prefix is the smaller suffix."""
    n = len(codes)
    after, shared, before, common = [n] * n, [0] * n, [-1] * n, [0] * n
    # What was matched furthest: from base to end the codes are those that stand shift earlier.
    base, shift, end = -1, 0, 0
    for i in range(n):
        j, last, length, copying, match = i - 1, -1, 0, i < end, None
        while j >= 0:
            if copying:
                # This pair met before, shift earlier.
                length = shared[j - shift] if after[j - shift] == i - shift else common[i - shift]
                fresh = length >= end - i
                if fresh:
                    length, copying = end - i, False
            elif last < 0:
                fresh = True
            else:
                # Of the extensions of last with j and with i the smaller one counts.
                fresh = common[last] == length
                length = min(length, common[last])
            if fresh:
                while i + length < n and codes[j + length] == codes[i + length]:
                    length += 1
                match = (i - j, i + length)
            if i + length < n and codes[i + length] > codes[j + length]:
                break
            after[j], shared[j] = i, length
            last, j = j, before[j]
        before[i], common[i] = j, length
        if match:
            base, (shift, end) = i, match
    return after, shared


def roots_extended(codes: list[int], least_length: int, least_exponent: int) -> set[Run]:
    """Runs as (start, length, period) whose roots are Lyndon words in the order of the codes."""
    after, shared = lyndon_array(codes)
    n, out = len(codes), set()
    for i in range(n):
        j = after[i]
        period, right = j - i, shared[i]
        need = max(least_length, least_exponent * period)
        if j == n or right + 2 * period - 1 < need or (i >= period and after[i - period] == i and shared[i - period] >= period):
            continue
        # It is the run's first root, so less than a period is left of it.
        left = 0
        while left < i and codes[i - left - 1] == codes[j - left - 1]:
            left += 1
        if left + period + right >= need:
            out.add((i - left, left + period + right, period))
    return out


def all_runs(codes: list[int], least_length: int = 2, least_exponent: int = 2) -> list[Run]:
    """Every run of at least that length and exponent, by start and period."""
    return sorted(roots_extended(codes, least_length, least_exponent) | roots_extended([-c for c in codes], least_length, least_exponent))


def open_stretches(codes: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Stretches [a, b) such that every run of that length and exponent, less its last period, lies
    in one of them; few or none in ordinary text."""
    n, share = len(codes), least_exponent - 1
    least = min(max(least_length, least_exponent * q) - q for q in range(1, least_length + 1))
    if n <= least or share < 1:
        return [(0, n)] if n else []
    order = np.argsort(codes, kind="stable")
    recurs = np.full(n, n, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    recurs[order[:-1][same]] = np.diff(order)[same]
    at, stretch = np.arange(n), np.zeros(n, np.int64)
    limit = np.array([n // share])
    while len(at):
        good = recurs[at] <= limit[stretch]
        whole = good.all()
        at, stretch = at[good], stretch[good]
        if not len(at):
            break
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (np.diff(at) > 1) | (np.diff(stretch) > 0)
        stretch = np.cumsum(new) - 1
        sizes = np.bincount(stretch)
        keep = sizes >= least
        if whole and keep.all():
            break
        limit = sizes // share
        some = keep[stretch]
        at, stretch = at[some], stretch[some]
    if not len(at):
        return []
    edges = np.flatnonzero(np.diff(stretch)) + 1
    first, last = at[np.concatenate([[0], edges])], at[np.concatenate([edges - 1, [len(at) - 1]])]
    return [(int(a), int(b) + 1) for a, b in zip(first, last, strict=True)]


def find_runs(codes: np.ndarray, least_length: int, least_exponent: int) -> list[Run]:
    """``all_runs``, where stretches without one are passed over."""
    out: list[Run] = []
    for a, b in open_stretches(codes, least_length, least_exponent):
        # The last period and the word after the run are within reach of the stretch's end.
        end = min(len(codes), b + (b - a) // max(least_exponent - 1, 1) + 1)
        some = all_runs(codes[a:end].tolist(), least_length, least_exponent)
        out += [(a + s, length, q) for s, length, q in some if a + s + length - q <= b]
    return sorted(out)


def word_codes(found: list[str]) -> np.ndarray:
    """Words as numbers in the order of their first sight."""
    names: dict[str, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in found), np.int64, len(found))


def split_words(text: str) -> list[str]:
    """The words of a text: what stands between blanks and the control characters tab to return."""
    for c in "\t\n\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def collapsed(found: list[str], runs: list[Run]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return found
    gone = np.zeros(len(found), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(found, gone.tolist(), strict=True) if not g]


def periodic_runs(df: DataFrame, least_length: int = 6, least_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, runs (array of start, length and period, in words, by start
    and period) and collapsed, the text's words but those that repeat what a run began with,
    joined by single blanks.

    A run has ``least_length`` words and ``least_exponent`` (2 or more) times its period at least.
    Null and texts without a word have no runs and an empty text; repeated rows stay; long texts
    take time in proportion; an empty table gives an empty result; extra columns are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some, runs, texts = batch.slice(at, BATCH), [], []
                for text in some.column(1):
                    found = split_words(text.as_py() or "")
                    here = find_runs(word_codes(found), least_length, least_exponent)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                    texts.append(" ".join(collapsed(found, here)))
                yield pa.record_batch([some.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_periods(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, where about a tenth of the texts repeat themselves from some word on.

    With h the crc32 of the decimal id and g = h // 10: where h % 10 is 0 and a text has n words,
    word i from a = g % n on becomes word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8), and
    the words are joined by blanks. Null ids change nothing.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    chosen = (h % 10 == 0) & F.col(text_col).isNotNull()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.floor(h / 10).alias("g"), F.when(chosen, words(F.col(text_col))).alias("w"))
    rows = rows.withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def planted(i: Column) -> Column:
        source = F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
        return F.get("w", source.cast("int"))

    new = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), planted), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` returns as digests: doc_id, n_runs, the run of the greatest exponent
    (of equal ones the first, then that of the smallest period; nulls without a run), and hashes of
    all runs and of the collapsed text."""
    # Exponents are quotients of whole numbers below 2**26, so different ones differ as doubles.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.q")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
