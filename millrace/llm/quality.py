"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``text_statistics`` derives the counts that rules read. ``order_rules`` asks every rule of a bounded
sample, in one job, and notes which texts each rejects and what it costs there, in characters read.
The rule that rejects most by its cost goes first; then the one that rejects most by its cost of what
is left; and so on. ``cascade`` asks the rules in that order and stops at the first that rejects.
The order decides the cost alone: a document is kept if no rule rejects it, so the verdict is the
same in any order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


#: What a comparison of counts costs, in characters read by a pattern.
COMPARISON = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document that the rule turns away; null counts as false. ``cost`` is
    what asking costs, by the document."""

    name: str
    rejects: Column
    cost: Column = field(default_factory=lambda: F.lit(COMPARISON))


def default_rules() -> list[Rule]:
    """Rules on the columns of ``text_statistics``; those on ``text`` read it once more."""
    n, length = F.greatest(F.col("n_words"), F.lit(1)), F.length("text")
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n), F.lit(2 * COMPARISON)),
        Rule("repeated_lines", F.col("n_dup_lines") * 2 > F.col("n_lines")),
        Rule("capitals", F.regexp_count(F.col("text"), F.lit(r"\p{Lu}")) * 2 > F.col("word_chars"), length),
        Rule("no_letters", F.regexp_count(F.col("text"), F.lit(r"\p{L}")) * 2 < F.col("word_chars"), length),
    ]


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and the counts of each text.

    Null and empty texts have no words and zero counts; one row per input row, so repeated ids
    stay repeated; other columns are left behind. A window is ``WINDOW`` neighbouring words, and
    ``n_repeat_words`` counts the words that stand in a window found twice or more in the text.

    Windows become 64-bit hashes. Only texts with an equal pair go on: their hashes are packed with
    the position in the low bits and sorted, equal neighbours give the positions, and each position
    covers the words up to the next one, five at most: O(n log n) for a text of any length.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("w", words(F.col("text")))
    base = base.select(
        "doc_id",
        "text",
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.slice(
            F.transform(
                "w",
                lambda x, i: F.xxhash64(x, *(F.get(F.col("w"), i + k) for k in range(1, WINDOW))),
            ),
            F.lit(1),
            F.greatest(F.size("w") - (WINDOW - 1), F.lit(0)),
        ).alias("h"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    bits = F.ceil(F.log2(F.col("n") + 2)).cast("int")
    base = base.select(
        "doc_id",
        "text",
        "n",
        "word_chars",
        bits.alias("bits"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(
                F.transform("h", lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long")))
            ),
        ).alias("s"),
    )
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    at = F.transform(
        F.filter(
            "s",
            lambda x, i: (high(x) == F.coalesce(high(F.get(F.col("s"), i + 1)), high(x) - 1))
            | ((i > 0) & (high(x) == high(F.get(F.col("s"), F.greatest(i - 1, F.lit(0)))))),
        ),
        lambda x: x.bitwiseAND(low),
    )
    base = base.withColumn("at", F.sort_array(at))
    gaps = F.transform(
        "at",
        lambda x, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(F.col("at"), i + 1) - x, F.lit(WINDOW))),
    )
    return base.select(
        "doc_id",
        "text",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        "n_lines",
        "n_dup_lines",
        F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n_repeat_words"),
    )


def order_rules(df: DataFrame, rules: list[Rule], sample_rows: int = 2000) -> list[Rule]:
    """``rules`` by rejections per cost on a sample of about ``sample_rows`` rows of ``df``, each
    measured on what the rules ahead of it let through; ties as they come.

    ``df`` has the columns of ``text_statistics``. Rows are taken by a hash of id and text, so the
    sample is spread over the table, the same in every run and that large however large the table
    is. Rows that the same rules reject are one group, so no more groups than rows come back.
    """
    total = df.select("doc_id").count()
    if not total or len(rules) < 2:
        return list(rules)
    picked = df.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(sample_rows / total * (1 << 40)) + 1)
    asked = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    asked += [r.cost.cast("double").alias(f"c{i}") for i, r in enumerate(rules)]
    keys = [f"r{i}" for i in range(len(rules))]
    groups = picked.select(*asked).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))))
    rest, left, out = groups.collect(), list(range(len(rules))), []

    def worth(i: int) -> float:
        return (sum(g["n"] for g in rest if g[f"r{i}"]) + 0.5) / (sum(g[f"c{i}"] or 0.0 for g in rest) + 1.0)

    while left:
        best = max(left, key=worth)
        left.remove(best)
        out.append(rules[best])
        rest = [g for g in rest if not g[f"r{best}"]]
    return out


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null. Later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def judge_quality(
    df: DataFrame,
    rules: list[Rule] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    sample_rows: int = 2000,
) -> DataFrame:
    """One row per input row: the counts, ``base_failed``, ``kept`` and ``rejected_by``.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat_percent`` percent of them
    in repeated windows. The cascade runs on the rest. An empty table gives an empty result.
    """
    stats = text_statistics(df, id_col, text_col)
    ordered = order_rules(stats, default_rules() if rules is None else rules, sample_rows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        stats.withColumn("base_failed", failed)
        .withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            F.col("rejected_by").isNull().alias("kept"), "rejected_by",
        )
    )
