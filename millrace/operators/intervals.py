"""Joins of dates with half-open windows that spread over tasks, however few the other keys are.

A window is cut into dyadic pieces, of 1, 2, 4 and so on days up to a widest one, each aligned to its
size; a date lies in one piece of each size. So the join is an equi-join on the keys, a size and a
piece, a date is in exactly one piece of a window that holds it, and the rows of one hot key are dealt
by their dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces are of 2**0 to 2**LEVELS days.
LEVELS = 5


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def pieces(since: Column, until: Column, levels: int) -> Column:
    """The pieces of [since, until), whole numbers, as structs level and piece; none if it is empty."""
    kind = "array<struct<level:int,piece:int>>"
    one = lambda wanted, level, piece: F.when(wanted, F.array(F.struct(level.cast("int").alias("level"), piece.cast("int").alias("piece")))).otherwise(F.array().cast(kind))

    def step(acc: Column, level: Column) -> Column:
        # What isn't aligned to the next size is cut off at either end, in units of this one.
        s, e = acc["s"], acc["e"]
        left, right = (s < e) & (s % 2 != 0), (s < e) & (e % 2 != 0)
        # A piece of one unit is cut off once.
        right = right & ~(left & (e - s == 1))
        found = F.concat(acc["found"], one(left, level, s), one(right, level, e - 1))
        # Halving rounds down, also below zero; both ends are even here.
        s, e = s + left.cast("int"), e - right.cast("int")
        return F.struct(F.floor(s / 2).cast("int").alias("s"), F.floor(e / 2).cast("int").alias("e"), found.alias("found"))

    def finish(acc: Column) -> Column:
        rest = F.when(acc["s"] < acc["e"], F.transform(F.sequence(acc["s"], acc["e"] - 1), lambda k: F.struct(F.lit(levels).cast("int").alias("level"), k.cast("int").alias("piece"))))
        return F.concat(acc["found"], F.coalesce(rest, F.array().cast(kind)))

    start = F.struct(since.cast("int").alias("s"), until.cast("int").alias("e"), F.array().cast(kind).alias("found"))
    if not levels:
        return finish(start)
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, finish)


def piece_rows(points: DataFrame, windows: DataFrame, at: str, since: str, until: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a row for each of their pieces, in _level and _piece."""
    span = points.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    low, high = F.lit(span["low"]).cast("date"), F.lit(span["high"]).cast("date")
    # Windows are cut to the dates there are, so that open ones end.
    first = F.greatest(F.coalesce(day_number(F.col(since)), day_number(low)), day_number(low))
    last = F.least(F.coalesce(day_number(F.col(until)), day_number(high) + 1), day_number(high) + 1)
    cut = windows.withColumn("_p", F.explode(pieces(first, last, levels))).withColumns({"_level": F.col("_p.level"), "_piece": F.col("_p.piece")}).drop("_p")
    day = day_number(F.col(at))
    own = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(day / F.pow(F.lit(2.0), k)).cast("int").alias("piece")))
    asked = points.where(F.col(at).isNotNull()).withColumn("_p", F.explode(own)).withColumns({"_level": F.col("_p.level"), "_piece": F.col("_p.piece")}).drop("_p")
    return asked, cut


def interval_join(points: DataFrame, windows: DataFrame, keys: list[str], at: str, since: str, until: str, levels: int = LEVELS) -> DataFrame:
    """``points`` joined to the ``windows`` of equal ``keys`` with since <= at < until, where null bounds
    are open. Points without a date, and null keys, match nothing; rows that repeat stay."""
    asked, cut = piece_rows(points, windows, at, since, until, levels)
    # A window has many pieces, which the planner's sizes don't know: they are shuffled, never broadcast.
    return asked.join(cut.hint("merge"), [*keys, "_level", "_piece"]).drop("_level", "_piece")


def interval_totals(points: DataFrame, windows: DataFrame, keys: list[str], at: str, since: str, until: str, count: str, totals: dict[str, str], levels: int = LEVELS) -> DataFrame:
    """``keys``, ``at``, ``count`` and sums over all pairs of ``interval_join``, for each key and date of
    ``points`` that has any. ``totals`` names a sum and the column of ``windows`` it is over; where that
    is null in all pairs the sum is null.

    Windows are summed up by piece before they meet points, so no pair is made: what is joined has a
    row for each piece of a key's days, however many windows there are."""
    asked, cut = piece_rows(points.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("_times")), windows, at, since, until, levels)
    sums = cut.groupBy(*keys, "_level", "_piece").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_{name}") for name, c in totals.items()))
    met = asked.join(sums.hint("merge"), [*keys, "_level", "_piece"])
    weighted = lambda c: F.sum(F.col("_times") * F.col(c))
    return met.groupBy(*keys, at).agg(weighted("_n").alias(count), *(weighted(f"_{name}").alias(name) for name in totals))
