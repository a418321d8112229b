"""Interval joins of marker regions with known regions and chromosomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the narrowest bins that turn an interval join into an equality join; how much wider those of the next level are, and
#: the levels (the widest bins hold whole chromosomes).
BIN, WIDER, LEVELS = 1_000, 8, 8
#: Rows of one side that meet under one key; a bin with more is split.
HOT = 10_000


def _placed(regions: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each level and bin in which a region is looked for: at its own level, where it covers few bins, and at all wider
    ones. ``_own`` tells the former."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(0))
    own = sum((F.when(length >= width * WIDER ** (level + 1), 1).otherwise(0) for level in range(LEVELS - 1)), F.lit(0))
    at = regions.select("*", own.alias("_least")).select("*", F.explode(F.sequence(F.col("_least"), F.lit(LEVELS - 1))).alias("_level"))
    wide = F.lit(width) * F.pow(F.lit(WIDER), F.col("_level")).cast("long")
    bins = F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor(F.col(end) / wide))).alias("_bin")
    return at.select("*", (F.col("_level") == F.col("_least")).alias("_own"), wide.alias("_wide"), bins).drop("_least")


def overlaps(left: DataFrame, right: DataFrame, width: int = BIN, hot: int = HOT) -> DataFrame:
    """Pairs of regions on one chromosome that share a base; the right side's columns get the prefix ``known_``.

    Bins have several widths. A region covers a few bins of its own level however long it is, and two regions meet at the
    wider one's level, in the first bin that both have, so no pair comes twice. A bin that holds more than ``hot`` rows of a
    side is split: its rows are dealt to parts, and those of the other side go to each. Regions with a null bound or
    chromosome, or that end before they start, meet nothing; repeated rows meet each; empty tables give no rows. ``left``
    has no columns ``known_...``, and neither side any that begin with ``_``.
    """
    known = right.select(*(F.col(c).alias(f"known_{c}") for c in right.columns)).where("known_start <= known_end AND known_chromosome IS NOT NULL")
    a = _placed(left.where("start <= end AND chromosome IS NOT NULL"), "start", "end", width)
    b = _placed(known, "known_start", "known_end", width)
    key = ["_chromosome", "_level", "_bin"]
    a, b = a.withColumn("_chromosome", F.col("chromosome")), b.withColumn("_chromosome", F.col("known_chromosome"))

    def crowded(side: DataFrame, to: str) -> DataFrame:
        return side.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*key, F.ceil(F.col("_n") / hot).cast("int").alias(to))

    parts = crowded(a, "_a").join(crowded(b, "_b"), key, "full").select(*key, F.coalesce("_a", F.lit(1)).alias("_a"), F.coalesce("_b", F.lit(1)).alias("_b"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = side.join(parts, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_a", "_b")})
        row = F.xxhash64(*(F.col(c) for c in side.columns if not c.startswith("_")))
        part, every = F.pmod(row, F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return mine.withColumn("_mine", part).withColumn("_other", every).select(*side.columns, F.col("_mine").alias(f"_part{own}"), F.col("_other").alias(f"_part{other}"))

    x = dealt(a, "_a", "_b").withColumnRenamed("_own", "_own_a")
    y = dealt(b, "_b", "_a").withColumnRenamed("_own", "_own_b").drop("_wide")
    met = x.join(y, [*key, "_part_a", "_part_b"])
    first = F.floor(F.greatest("start", "known_start") / F.col("_wide"))
    met = met.where((F.col("start") <= F.col("known_end")) & (F.col("end") >= F.col("known_start")) & (F.col("_bin") == first) & (F.col("_own_a") | F.col("_own_b")))
    return met.select(*left.columns, *known.columns)


def novel(left: DataFrame, right: DataFrame, key: list[str], width: int = BIN) -> DataFrame:
    """Rows of ``left`` that overlap no region of ``right``; ``key`` tells its rows apart (nulls are values): of rows with one
    key all go if one overlaps. Rows with a null bound overlap nothing and stay; with an empty ``right`` all stay."""
    hit = overlaps(left.select(*key, "chromosome", "start", "end"), right.select("chromosome", "start", "end"), width)
    hit = hit.select(*(F.col(k).alias(f"_hit_{k}") for k in key)).distinct()
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_hit_{k}")) for k in key))
    return left.join(hit, same, "left_anti")


def out_of_bounds(regions: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Regions that lie on no listed chromosome, or not wholly inside a row of it. A null chromosome or bound lies nowhere;
    repeated chromosomes are harmless, repeated regions stay; without chromosomes all are out of bounds."""
    inside = (F.col("r.chromosome") == F.col("b.chromosome")) & (F.col("r.start") >= F.col("b.start")) & (F.col("r.end") <= F.col("b.end"))
    return regions.alias("r").join(chromosomes.alias("b"), inside, "left_anti")


def coloured(regions: DataFrame, palette: DataFrame, default: str = "grey") -> DataFrame:
    """Regions with their class's colour, or the default. Of a class listed twice the first colour in order counts; a null
    class has the default; a column ``colour`` is replaced."""
    known = palette.groupBy("class").agg(F.min("colour").alias("_colour"))
    return regions.drop("colour").join(known, "class", "left").withColumn("colour", F.coalesce("_colour", F.lit(default))).drop("_colour")
