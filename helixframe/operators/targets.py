"""De-duplicated targets and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.enzymes import Enzyme
from helixframe.scratch import cut

#: Places of a target are first gathered by contig and stretches of 2^STRETCH bases, which bounds a list.
STRETCH = 16


def build_targets(sites: DataFrame, enzyme: Enzyme, positions: bool = True) -> DataFrame:
    """One row per distinct target: bases, enc (compared bases, packed), cnt and its positions in order.

    Counts and positions stop at 32767.  Without ``positions`` only counts are shuffled.  With them, places are gathered by
    target and stretch of the genome; a target of more places than that is cut behind the stretch in which its 32767th lies, which
    running sums over the stretches' counts find, before its list is made.  So no task meets all places of a
    repeat family, and its list is of at most that many and one stretch.
    """
    if not positions:
        out = sites.groupBy("bases").agg(F.least(F.count(F.lit(1)), F.lit(dna.COUNT_CAP)).cast("int").alias("cnt"))
        return out.withColumn("enc", dna.encode(enzyme.key(F.col("bases"))))
    place = F.struct("contig_idx", "start", (~F.col("fwd")).alias("rev"), "contig", (F.col("stop") - F.col("start")).alias("len"))
    stretch = F.struct("contig_idx", F.shiftright("start", STRETCH).alias("nth")).alias("stretch")
    stretches = cut(sites.groupBy("bases", stretch).agg(F.collect_list(place).alias("places"), F.count(F.lit(1)).alias("n")), "stretches")
    # Few targets are so frequent: at most one in 32767 sites.
    full = stretches.groupBy("bases").agg(F.sum("n").alias("all")).where(F.col("all") > dna.COUNT_CAP).select("bases")
    order = W.partitionBy("bases").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = stretches.select("bases", "stretch", "n").join(full, "bases", "left_semi").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    ends = cut(counts.where(F.col("before") < dna.COUNT_CAP).groupBy("bases").agg(F.max("stretch").alias("end")), "stretch-ends")
    near = stretches.join(ends, "bases", "left").where(F.col("end").isNull() | (F.col("stretch") <= F.col("end"))) if ends.limit(1).count() else stretches
    listed = F.slice(F.sort_array(F.flatten(F.collect_list("places"))), 1, dna.COUNT_CAP)
    out = near.groupBy("bases").agg(listed.alias("listed"))
    shaped = F.transform("listed", lambda p: F.struct(p["contig"].alias("contig"), p["start"].alias("start"), p["len"].alias("len"), (~p["rev"]).alias("fwd")))
    return out.select("bases", F.size("listed").alias("cnt"), shaped.alias("positions")).withColumn("enc", dna.encode(enzyme.key(F.col("bases"))))


def count_range(targets: DataFrame, low: int = 0, high: int = 2**31 - 1) -> DataFrame:
    return targets.where(F.col("cnt").between(low, high))


def bin_counts(targets: DataFrame, enzyme: Enzyme, bin_size: int = 7) -> DataFrame:
    """Targets and their occurrences by the first bases behind a 5' PAM."""
    first = enzyme.length - enzyme.guide + 1 if enzyme.five_prime else 1
    return targets.groupBy(F.substring("bases", first, bin_size).alias("bin")).agg(
        F.count(F.lit(1)).alias("targets"), F.sum("cnt").alias("occurrences")
    )


def kmer_table(spark, k: int) -> DataFrame:
    """All strings of k bases."""
    return spark.range(4**k).select("id", dna.kmers(F.col("id"), k).alias("kmer"))


def subsample(targets: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """A share of the targets, chosen by a hash of seed and bases, so that reruns agree."""
    return targets.where(dna.draw(F.lit(f"{seed}:"), F.col("bases")) < int(share * (1 << 52)))
