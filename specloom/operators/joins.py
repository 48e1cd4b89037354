"""Joins that measure their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of either side that meet in one part, and how many keys are split at most: any other key has
#: fewer pairs than each of these, so under one in HOT of all.
SIDE, HOT = 1024, 4096


def sized_join(left: DataFrame, right: DataFrame, on: list[str], side: int = SIDE) -> DataFrame:
    """The inner join of two sides. Rows of each key are counted on both, and a key whose pairs don't fit
    ``side`` x ``side`` is cut to a grid: its left rows are dealt over the grid's rows and its right rows
    over the columns, each sent to all cells of its row or column. No task gets a key as a whole. Rows are
    dealt by a hash of their values, so rows that are equal in all of them stay together.

    Both sides are read twice, so they should be tables or cheap. What is broadcast are the keys to
    split, HOT rows at most, whatever the input and however small its files are."""
    counts = [df.groupBy(*on).agg(F.count("*").alias(n)) for df, n in ((left, "_l"), (right, "_r"))]
    sizes = counts[0].join(counts[1].hint("merge"), on).where(F.col("_l") * F.col("_r") > side * side)
    hot = sizes.orderBy(F.desc(F.col("_l") * F.col("_r"))).limit(HOT).select(*on, *[F.ceil(F.col(n) / side).cast("int").alias(n) for n in ("_l", "_r")])
    hot = F.broadcast(hot)

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(hot, on, "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in ("_l", "_r")})
        named = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
        place = F.pmod(F.xxhash64(*named), F.col(own)).cast("int")  # by value: the same if a task runs again
        return rows.withColumns({f"{own}p": place, f"{other}p": F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("_l", "_r")

    return cells(left, "_l", "_r").join(cells(right, "_r", "_l").hint("merge"), [*on, "_lp", "_rp"]).drop("_lp", "_rp")
