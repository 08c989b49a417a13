"""Mixing sources to target weights (operator 9): Efraimidis-Spirakis sampling.

Everything here is DataFrame code.  Each source has a token target.  Whole epochs come
first; the rest of the target is a weighted sample without replacement: every document
draws an exponential key whose rate is its quality weight, and the smallest keys are
taken until their sizes reach the budget.

No source is ever sorted in one task.  Keys are mapped monotonically to [0, 1) and cut
into ``FAN`` x ``FAN`` ranges; sizes are summed by range, the range that holds the budget's end is
found by a running sum over at most ``FAN`` rows a source, and only that range's rows are sorted.

Nulls and edge cases: a null text has size 0; a null source is a source of its own and
comes last; a source of size 0 takes 0; documents of size 0 take 0; a draw is made of id and text, so rows
without ids or with one id draw apart; equal rows draw the same key and are taken in turn; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import cut, table

WEIGHTS = (5, 2, 1)
CAP = 3
FAN = 1024
SEED = "mix-1"
LEAST_WEIGHT = 0.1
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, fan: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the documents with their size, draw, and ranges of draws mix_b1 and mix_b2."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    head = F.substring(F.md5(own), 1, 13)
    u = (F.conv(head, 16, 10).cast("double") + 1.0) / float(2**52 + 2)
    out = docs.select(*keep, size.alias("mix_size"), F.length("text").cast("double").alias("mix_chars"), u.alias("mix_u"))
    mean = F.col("mix_chars") / F.col("mix_size")
    weight = F.when(F.col("mix_size") > 0, F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.abs(mean - 6.0) / 10.0)).otherwise(F.lit(LEAST_WEIGHT))
    out = out.withColumn("mix_draw", -F.log("mix_u") / weight).drop("mix_chars", "mix_u")
    # On the scale of the least weight no range is far fuller than the others, whatever the weights are.
    place = F.lit(1.0) - F.exp(-F.col("mix_draw") * LEAST_WEIGHT)
    first, second = F.floor(place * fan), F.floor(place * fan * fan) % fan
    return out.withColumn("mix_b1", first.cast("int")).withColumn("mix_b2", second.cast("int"))


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets by source from ``sums(source, source_size)``: water filling in closed form.

    Sources fill in order of cap / weight; one is full if the level reached when all
    before it are full is at least its own ratio.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    t = sums.withColumn("nth", nth).withColumn("w", weight).withColumn("cap", F.col("source_size") * cap)
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    t = (
        t.withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    level = (F.col("all_size") - F.col("cap_before")).cast("double") / (F.col("all_w") - F.col("w_before"))
    t = t.withColumn("full", F.col("ratio") <= level)
    t = t.withColumn("full_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    t = t.withColumn("open_w", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every))
    open_target = F.col("w") * ((F.col("all_size") - F.col("full_cap")).cast("double") / F.nullif(F.col("open_w"), F.lit(0.0)))
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_target))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return t.select("source", "source_size", "target", epochs.cast("long").alias("epochs"), budget.cast("long").alias("budget")).withColumn(
        "rest", F.greatest(F.lit(0), F.col("budget") - F.col("epochs") * F.col("source_size"))
    )


def _edge(rows: DataFrame, keys: list[str], fan: str, rest: str) -> DataFrame:
    """Of each key's ranges ``fan``, the one in which the running size reaches ``rest``."""
    run = W.partitionBy("source").orderBy(fan).rowsBetween(W.unboundedPreceding, 0)
    by = rows.groupBy(*keys, rest, fan).agg(F.sum("mix_size").alias("part"))
    by = by.withColumn("upto", F.sum("part").over(run))
    hit = by.where((F.col("upto") >= F.col(rest)) & (F.col("upto") - F.col("part") < F.col(rest)))
    return hit.select(*keys, F.col(fan), (F.col(rest) - F.col("upto") + F.col("part")).alias(rest + "_in"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: mix_source, source_size, target, epochs, and where its budget ends: ranges c1 and c2 with ``left`` words to take there."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sums = rows.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    out = cut(targets(sums, weights, cap).coalesce(1), "mix-plan").withColumnRenamed("source", "mix_source")
    need = out.where("rest > 0").select(F.col("mix_source").alias("s"), "rest")
    one = cut(_edge(rows.join(need, same("source", "s")).drop("s"), ["source"], "mix_b1", "rest").coalesce(1), "mix-b1")
    near = one.select(F.col("source").alias("s"), F.col("mix_b1").alias("c1"), "rest_in")
    inside = rows.join(near, same("source", "s") & (F.col("mix_b1") == F.col("c1"))).drop("s", "c1")
    two = cut(_edge(inside, ["source", "mix_b1"], "mix_b2", "rest_in").coalesce(1), "mix-b2")
    two = two.select(F.col("source").alias("s"), F.col("mix_b1").alias("c1"), F.col("mix_b2").alias("c2"), F.col("rest_in_in").alias("left"))
    return cut(out.join(two, same("mix_source", "s"), "left").select("mix_source", "source_size", "target", "epochs", "c1", "c2", "left").coalesce(1), "mix-ends")


def take(rows: DataFrame, ends: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``sized`` rows with source_size, target and taken.

    The plan has a row a source and is broadcast if it is small; only rows in the range where a budget ends are sorted.
    """
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("mix_source")))
    here = F.coalesce((F.col("mix_b1") == F.col("c1")) & (F.col("mix_b2") == F.col("c2")), F.lit(False))
    below = F.coalesce((F.col("mix_b1") < F.col("c1")) | ((F.col("mix_b1") == F.col("c1")) & (F.col("mix_b2") < F.col("c2"))), F.lit(False))
    once = F.col("epochs") * F.col("mix_size")
    keep = [*keep, "source_size", "target"]
    whole = rows.where(~here).select(*keep, (once + F.when(below, F.col("mix_size")).otherwise(0)).cast("long").alias("taken"))
    run = W.partitionBy("source").orderBy("mix_draw", "doc_id", "mix_size").rowsBetween(W.unboundedPreceding, 0)
    edge = rows.where(here).withColumn("upto", F.sum("mix_size").over(run))
    got = F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("left") - F.col("upto") + F.col("mix_size")))
    return whole.unionByName(edge.select(*keep, (once + got).cast("long").alias("taken")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, fan: int = FAN) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words ``taken`` by the mix.

    The document at the end of a budget is taken in part, so that each source's words
    equal its rounded target.
    """
    rows = cut(sized(docs, fan, ["doc_id", "source"]), "mix")
    out = take(rows, plan(rows, weights, cap), ["doc_id", "mix_size"])
    return out.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document appears ``taken / size`` times, rounded to whole copies.

    Documents without words carry no weight in a mix and stay once.  Texts are not shuffled: sizes
    and draws are computed again beside them and meet the plan of a row a source.
    """
    # The row travels as one struct, so that no column of it meets a name of the plan.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("doc_id", "source", "text", whole.alias("mix_row"))
    ends = plan(cut(sized(rows, FAN, ["doc_id", "source"]), "mix"))
    out = take(sized(rows, FAN, ["doc_id", "source", "mix_row"]), ends, ["mix_row", "mix_size"])
    copies = F.when(F.col("mix_size") > 0, F.floor(F.col("taken") / F.col("mix_size") + 0.5)).otherwise(1).cast("int")
    out = out.withColumn("mix_copies", copies).where("mix_copies > 0")
    out = out.select("mix_row", F.explode(F.sequence(F.lit(1), "mix_copies")).alias("mix_copy"))
    return out.select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.withColumn("target", F.round("target", 6))


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, length(text) as n,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint::double + 1.0) / 4503599627370498.0 as u
  from documents
), k as (
  select *, -ln(u) / (case when size > 0 then greatest(0.1::double, 1.0::double - abs(n::double / size - 6.0) / 10.0) else 0.1::double end) as draw from d
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as nth from k group by source
), w as (
  select *, (case nth % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w, source_size * 3 as cap from s
), o as (
  select *, cap / w as ratio, sum(source_size) over () as all_size, sum(w) over () as all_w,
         coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
         coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as w_before
  from w
), f as (
  select *, ratio <= (all_size - cap_before)::double / (all_w - w_before) as is_full from o
), g as (
  select *, sum(case when is_full then cap else 0 end) over () as full_cap, sum(case when is_full then 0 else w end) over () as open_w from f
), t as (
  select source, source_size, case when is_full then cap::double else w * ((all_size - full_cap)::double / nullif(open_w, 0)) end as target from g
), b as (
  select *, (case when source_size > 0 then floor(target / source_size) else 0 end)::bigint as epochs from t
), c as (
  select *, greatest(0, floor(target + 0.5)::bigint - epochs * source_size) as rest from b
), r as (
  select k.doc_id, k.size, c.source_size, c.target, c.epochs, c.rest,
         sum(k.size) over (partition by k.source order by k.draw, k.doc_id, k.size rows unbounded preceding) as upto
  from k join c on k.source is not distinct from c.source
)
select doc_id, size, source_size, round(target, 6) as target,
       (epochs * size + greatest(0, least(size, rest - upto + size)))::bigint as taken from r
"""
