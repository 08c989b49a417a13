"""Rank aggregation over several scores of each guide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.scratch import cut

TRANCHES, TOP = 4, 1000
#: Distinct scores of a range are about so many at most.
RANGE_SCORES = 1_000_000
WORST_HIGH, WORST_LOW = float(-(2**31)), float(2**31 - 1)


def tie_rank(frame: DataFrame, score: str, rank: str, high_is_good: bool) -> DataFrame:
    """Competition rank plus half the number of ties, rounded down; ``frame`` is read twice.

    Only distinct scores are ranked, so ties meet as one row.  These are dealt out by ranges and sorted; a first pass over
    the written ranges sums each partition, the sums (a row a partition) are added up, and a second pass
    counts on from them.  The number of partitions follows the shuffle settings, so no task orders more than its share, however many scores there are.
    A score that is null or not a number is the worst.
    """
    worst = WORST_HIGH if high_is_good else WORST_LOW
    rows = frame.withColumn("_value", F.coalesce(F.col(score).try_cast("double"), F.lit(worst)))
    value = -F.col("_value") if high_is_good else F.col("_value")
    counts = rows.groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    parts = max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // RANGE_SCORES))
    ordered = cut(counts.repartitionByRange(parts, value).withColumn("_range", F.spark_partition_id()), "score-ranges")
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = ordered.groupBy("_range").agg(F.sum("_n").alias("_sum"))  # a row a partition
    base = base.select("_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranks = ordered.join(F.broadcast(base), "_range").select(F.col("_value").alias("_key"), (before + 1 + F.floor(F.col("_n") / 2)).cast("long").alias(rank))
    return rows.join(cut(ranks, "score-ranks"), F.col("_value") == F.col("_key")).drop("_value", "_key")


def aggregate_ranks(frame: DataFrame, scores: dict[str, bool], key: str = "guide_id", tranches: int = TRANCHES, top: int = TOP) -> DataFrame:
    """Median of the scores' ranks, its own rank, tranche, and place among the best.

    ``scores`` maps a column to whether high is good.  ``top_x`` is the place in median order, null
    beyond the first quarter (at most ``top``); ties there are ordered by ``key``.  Without scores all three are null.
    """
    if not scores:
        return frame.select(key, *[F.lit(None).cast("long").alias(c) for c in ("median_rank", "tranche", "top_x")])
    ranked, names = cut(frame.select(key, *scores), "scores"), []
    guides = ranked.count()
    for column, high in scores.items():
        names.append(f"rank_{column}")
        ranked = tie_rank(ranked, column, names[-1], high)
    ranked = cut(ranked.withColumn("median", dna.median(F.array(*[F.col(n) for n in names]))), "medians")
    ranked = tie_rank(ranked, "median", "median_rank", False)
    size = F.lit(min(-(-guides // tranches), top))
    best = ranked.orderBy("median", key).limit(top)
    place = best.select(F.col(key).alias("_k"), F.row_number().over(W.orderBy("median", key)).cast("long").alias("top_x"), size.alias("_size"))
    place = place.where(F.col("top_x") <= F.col("_size")).drop("_size")
    out = ranked.join(F.broadcast(place), F.col(key) == F.col("_k"), "left")  # at most ``top`` rows
    return out.select(key, *names, "median", "median_rank", F.ceil(F.col("median_rank") * tranches / guides).cast("long").alias("tranche"), "top_x")


def schulze(frame: DataFrame, votes: list[str], key: str) -> DataFrame:
    """Rank from 0 and score of each candidate by Schulze's method over summed votes: key, score, rank.

    A preference is the difference of two candidates' sums, so the widest path from one to another is the direct one
    (its steps add up to that difference), and a score is the sum of the differences to all lower candidates: running counts and
    sums over the distinct sums.  Equal scores are ranked by key.  For few candidates: the distinct sums are ordered in one task.
    """
    sums = frame.select(key, sum((F.col(v).cast("long") for v in votes[1:]), F.col(votes[0]).cast("long")).alias("_s"))
    lower = W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    by = sums.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    score = F.col("_s") * F.coalesce(F.sum("_n").over(lower), F.lit(0)) - F.coalesce(F.sum(F.col("_n") * F.col("_s")).over(lower), F.lit(0))
    scored = sums.join(by.withColumn("score", score).drop("_n"), "_s")
    return scored.select(key, F.col("score").cast("long").alias("score"), (F.row_number().over(W.orderBy(F.col("score").desc(), key)) - 1).cast("long").alias("rank"))
