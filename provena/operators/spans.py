"""Interval operators on half-open spans of a source: containment, overlap and innermost regions.

Spans are dealt to cells so that an interval join is an equi join on (source, level, cell) with a residual condition, never a cross
join. The cells of a level are ``STEP`` times as wide as those of the one below; a span goes to the first level whose cells are as wide
as it, so it lies in two of them at most, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.graph import first_by

STEP = 16


def _level(width: int) -> Column:
    """The first level whose cells are as wide as the span."""
    size = F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double")
    return F.greatest(F.lit(0), F.ceil(F.log(size / width) / F.log(F.lit(float(STEP))) - 1e-9)).cast("int")


def _at(place: Column, level: Column, width: int) -> Column:
    return F.floor(place / (width * F.pow(F.lit(float(STEP)), level)))


def _levels(regions: DataFrame, width: int) -> list[int]:
    """The levels in use: at most as many as a 64-bit place has hexadecimal digits."""
    return sorted(r[0] for r in regions.select(_level(width)).distinct().collect())


def _cells(df: DataFrame, width: int, levels: list[int]) -> DataFrame:
    """Each span in its cells of its own level and of those of ``levels`` above it: ``level, cell`` and ``own``, its own level."""
    df = df.withColumn("own", _level(width)).withColumn("level", F.explode(F.array_union(F.array("own"), F.array(*map(F.lit, levels)).cast("array<int>")))).where("level >= own")
    last = F.greatest(F.col("start"), F.col("end") - 1)
    return df.withColumn("cell", F.explode(F.sequence(_at(F.col("start"), F.col("level"), width), _at(last, F.col("level"), width))))


def containing(inner: DataFrame, regions: DataFrame, width: int = 4096) -> DataFrame:
    """``inner`` (``source, start, end``, any columns) joined to every region (``source, start, end, region``) that contains it."""
    levels = _levels(regions, width)
    a = inner.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("cell", _at(F.col("start"), F.col("level"), width))
    r = _cells(regions, width, []).select(F.col("source").alias("r_source"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "region", F.col("level").alias("r_level"), F.col("cell").alias("r_cell"))
    inside = (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end"))
    return a.join(r, (a.source == r.r_source) & (a.level == r.r_level) & (a.cell == r.r_cell) & inside).drop("level", "cell", "r_level", "r_cell", "r_source")


def tagged(inner: DataFrame, regions: DataFrame, key: list[str], width: int = 4096) -> DataFrame:
    """Each row of ``inner`` with the sorted distinct regions that contain it (``regions``; empty if none)."""
    found = containing(inner, regions, width).groupBy(*key).agg(F.array_sort(F.collect_set("region")).alias("regions"))
    return inner.join(found, key, "left").withColumn("regions", F.coalesce("regions", F.array().cast("array<string>")))


def innermost(inner: DataFrame, regions: DataFrame, key: list[str], width: int = 4096) -> DataFrame:
    """Each contained row with its smallest region."""
    return first_by(containing(inner, regions, width), key, [F.col("r_end") - F.col("r_start"), F.col("r_start"), F.col("region")])


def overlapping(a: DataFrame, b: DataFrame, width: int = 4096) -> DataFrame:
    """Pairs of overlapping spans: ``a`` and ``b`` have ``source, start, end, id``; the result ``source, a_id, b_id``."""
    both = sorted({*_levels(a, width), *_levels(b, width)})
    x = _cells(a, width, both).select("source", "level", "cell", F.col("own").alias("a_own"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("id").alias("a_id"))
    y = _cells(b, width, both).select("source", "level", "cell", F.col("own").alias("b_own"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("id").alias("b_id"))
    # a pair meets on the coarser one's level, and is taken in its first common cell
    pairs = x.join(y, ["source", "level", "cell"]).where("a_start < b_end and b_start < a_end and level = greatest(a_own, b_own)")
    return pairs.where(F.col("cell") == _at(F.greatest("a_start", "b_start"), F.col("level"), width)).select("source", "a_id", "b_id")


def overlapping_any(a: DataFrame, b: DataFrame, width: int = 4096) -> DataFrame:
    """The rows of ``a`` that overlap some span of ``b``."""
    hit = overlapping(a, b, width).select("source", F.col("a_id").alias("id")).distinct()
    return a.join(hit, ["source", "id"], "left_semi")


def outside(a: DataFrame, regions: DataFrame, key: list[str], width: int = 4096) -> DataFrame:
    """The rows of ``a`` that no region contains (facts inside inert declarations are left out this way)."""
    return a.join(containing(a, regions, width).select(*key).distinct(), key, "left_anti")


def misplaced(spans: DataFrame) -> DataFrame:
    """Spans that start before an earlier span of their source has ended, for admission checks of text edits. Of equal spans the one
    whose other columns are least comes first, whatever the order of rows."""
    from pyspark.sql import Window

    rest = [c for c in spans.columns if c not in ("source", "start", "end")]
    before = Window.partitionBy("source").orderBy("start", "end", *rest).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max("end").over(before)).where("start < reached or start > end").drop("reached")
