"""Interval annotation of sites: overlap join and coordinate remap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna

#: Lengths of the levels' bins are 2^12 (4,096) bases, then eight times as long each, up to 2^33.
LEVELS = tuple(range(12, 34, 3))


def _level(start: str, stop: str) -> Column:
    """The finest level at which an interval touches at most two bins."""
    last, out = F.greatest(F.col(stop) - 1, F.col(start)), F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        out = F.when(F.shiftright(last, level) - F.shiftright(F.col(start), level) <= 1, level).otherwise(out)
    return out


def _bins(start: str, stop: str) -> Column:
    """The bins (level, number) of an interval at its ``_level``."""
    at = lambda c: F.expr(f"shiftright({c}, _level)")
    return F.transform(F.sequence(at(f"`{start}`"), at(f"greatest(`{stop}` - 1, `{start}`)")), lambda n: F.struct(F.col("_level").alias("level"), n.alias("nth")))


def overlap_join(sites: DataFrame, intervals: DataFrame, key: list[str], column: str) -> DataFrame:
    """Left join: ``column`` lists the names of the intervals that overlap a site, in file order, joined by commas, else NA.

    ``intervals(contig, start, stop, name, idx)``.  Bins are nested: an interval goes to the one or two bins of the
    level that fits its length, a chromosome as well as a gene, and a site looks at its bins of all levels that any interval uses.  So it is an
    equi-join on contig, level and bin, and a pair counts in the first bin that it shares.  Rows that repeat get the list of one.
    """
    place = list(dict.fromkeys([*key, "contig", "start", "stop"]))
    right = intervals.select(F.col("contig").alias("_c"), F.col("start").cast("long").alias("_s"), F.col("stop").cast("long").alias("_e"), "name", "idx")
    right = right.withColumn("_level", _level("_s", "_e"))
    right = right.withColumn("_other", F.explode(_bins("_s", "_e"))).drop("_level")
    used = [r[0] for r in right.select("_other.level").distinct().collect()]  # of at most eight levels
    left = sites.select(*place).distinct().withColumns({"_from": F.col("start").cast("long"), "_to": F.greatest(F.col("stop") - 1, F.col("start")).cast("long")})
    bin_of = lambda n: lambda k: F.struct(F.lit(n).alias("level"), k.alias("nth"))
    levels = [F.transform(F.sequence(F.shiftright("_from", n), F.shiftright("_to", n)), bin_of(n)) for n in sorted(used)]
    left = left.withColumn("_bin", F.explode(F.concat(*levels))) if used else left.withColumn("_bin", F.lit(None).cast("struct<level:int,nth:bigint>"))
    hit = (F.col("contig") == F.col("_c")) & (F.col("_bin") == F.col("_other")) & dna.overlaps(F.col("start"), F.col("stop"), F.col("_s"), F.col("_e"))
    first = F.greatest(F.expr("shiftright(_from, _bin.level)"), F.expr("shiftright(_s, _bin.level)"))
    pairs = left.join(right, hit).where(F.col("_bin.nth") == first)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]), ",")
    found = pairs.groupBy(*place).agg(names.alias(column))
    return sites.join(found, place, "left").withColumn(column, F.coalesce(F.col(column), F.lit("NA"))).select(*sites.columns, column)


def remap(sites: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move sites of a contig named in ``mapping(old_contig, contig, start)`` to its place; the old name is kept."""
    m = mapping.select(F.col("old_contig").alias("_old"), F.col("contig").alias("_new"), F.col("start").alias("_shift"))
    out = sites.join(m, F.col("contig") == F.col("_old"), "left")
    shift = F.coalesce("_shift", F.lit(0))
    changed = {"start": F.col("start") + shift, "stop": F.col("stop") + shift, "contig": F.coalesce("_new", "contig")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in sites.columns], F.coalesce("_old", F.lit("NA")).alias("old_contig"))
