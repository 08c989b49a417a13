"""Queries over the driver's tables and their SQL counterparts.

The tables hold no nucleotides.  The document genome makes some: a document is a contig whose
letters, lower-cased, are mapped to bases.  Searches take as guides every target whose id, a hash of its bases, is divisible by 20,
or the first site of each benchmark passage, against all targets; all other queries use all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.enzymes import ENZYMES, Enzyme, enzyme
from helixframe.operators import folding as fold
from helixframe.operators import intervals, randoms, ranking, scoring, search, seek, sites, targets
from helixframe.scratch import cut, scratch_path
from helixframe.sources import bed, fasta, guide_table
from helixframe.sources import index as target_index

LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTTGCAACGTGTCACATGGTACTC"
NGG, CPF1 = enzyme("spcas9ngg"), enzyme("cpf1")
EVERY = 20
#: A low limit, so that guides overflow in tables of this size.
LOW_LIMIT = 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def genome(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = texts.select(F.col(key).cast("string").alias("contig"), F.col(key).alias("contig_idx"), F.lower("text").alias("seq"))
    return rows.mapInArrow(_as_bases, rows.schema)


def _as_bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = bytes.maketrans(LETTERS.encode(), AS_BASES.encode())
    drop = bytes(set(range(256)) - set(LETTERS.encode()))
    for batch in batches:
        seq = [x if x is None else x.translate(table, drop) for x in batch.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(seq, pa.binary()).cast(pa.string())], batch.schema.names)


def ngg_sites(spark: SparkSession, sf_dir: str, flank: int = 0, nuclease: Enzyme = NGG) -> DataFrame:
    return sites.find_sites(genome(spark, sf_dir), nuclease, flank)


def ngg_targets(spark: SparkSession, sf_dir: str, positions: bool = False, nuclease: Enzyme = NGG) -> DataFrame:
    return targets.build_targets(ngg_sites(spark, sf_dir, 0, nuclease), nuclease, positions)


def as_guides(found: DataFrame) -> DataFrame:
    """A guide's id packs all bases, as targets that differ in the PAM alone share their compared bases."""
    return found.select(dna.encode(F.col("bases")).alias("guide_id"), "bases", "enc")


def some_guides(found: DataFrame) -> DataFrame:
    """Targets whose hashed id is divisible by 20, so that no base of theirs is fixed."""
    return as_guides(found.where(dna.draw(F.col("bases")) % EVERY == 0))


def passage_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first site of each benchmark passage."""
    found = sites.find_sites(genome(spark, sf_dir, "benchmark", "item_id"), NGG)
    first = found.groupBy("contig_idx").agg(F.min_by("bases", F.struct("start", ~F.col("fwd"))).alias("bases")).select("bases").distinct()
    return cut(as_guides(first.withColumn("enc", dna.encode(NGG.key(F.col("bases"))))), "guides")


def ngg_hits(spark: SparkSession, sf_dir: str, strategy: str = "auto", most: int = 4, nuclease: Enzyme = NGG, positions: bool = False) -> DataFrame:
    found = cut(ngg_targets(spark, sf_dir, positions, nuclease), "targets")  # read as guides and as targets
    return search.discover(cut(some_guides(found), "guides"), found, nuclease, most, strategy, found.count())


def ngg_hits_until(spark: SparkSession, sf_dir: str, limit: int, most: int = 4, nuclease: Enzyme = NGG) -> DataFrame:
    found = cut(ngg_targets(spark, sf_dir, False, nuclease), "targets")
    return search.discover_until(cut(some_guides(found), "guides"), found, nuclease, most, limit)


def ngg_index(spark: SparkSession, sf_dir: str) -> target_index.Index:
    path, contigs = scratch_path(spark, "index"), genome(spark, sf_dir)
    target_index.write_index(ngg_targets(spark, sf_dir), NGG, path, contigs.select("contig", "contig_idx", F.length("seq").alias("length")))
    return target_index.read_index(spark, path)


# SQL building blocks.


def _enc(text: str, first: int = 1, n: int = 20) -> str:
    return "(" + " + ".join(f"((instr('ACGT', substr({text}, {first + k}, 1)) - 1)::bigint << {2 * (n - 1 - k)})" for k in range(n)) + ")"


def _revcomp(text: str) -> str:
    return f"reverse(translate({text}, 'ACGT', 'TGCA'))"


_DRAW = lambda key: f"('0x' || substr(md5({key}), 1, 13))::bigint"
GENOME_SQL = f"""
chunked as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}') as seq from documents)
"""


def sites_sql(nuclease: Enzyme, flank: int = 0, name: str = "sites", source: str = "chunked") -> str:
    n = nuclease.length
    flip = lambda p: p.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    quoted = lambda pams: ", ".join(f"'{p}'" for p in pams)
    size = len(nuclease.pams[0])
    end = lambda head, pams: f"substr(w, {1 if head else n - size + 1}, {size}) in ({quoted(pams)})"
    fwd, rev = end(nuclease.five_prime, nuclease.pams), end(not nuclease.five_prime, tuple(map(flip, nuclease.pams)))
    around = f"case when start >= {flank} and start + {n + flank} <= size then substr(piece, start - first + 1 - {flank}, {n + 2 * flank}) end"
    return f"""
pieces_{name} as (
  select doc_id, length(seq) as size, part * 256 as base, greatest(part * 256 - {flank}, 0) as first,
         substr(seq, greatest(part * 256 - {flank}, 0) + 1, {256 + n - 1 + 2 * flank}) as piece
  from (select doc_id, seq, unnest(range(0, (length(seq) - {n}) // 256 + 1)) as part from {source} where length(seq) >= {n})
), windows_{name} as (
  select doc_id, start, w, ctx from (
    select doc_id, start, substr(piece, start - first + 1, {n}) as w, {around} as ctx
    from (select *, base + unnest(range(0, least(256, size - {n} + 1 - base))) as start from pieces_{name}))
), {name} as (
  select doc_id::varchar as contig, doc_id as contig_idx, start, start + {n} as stop, w as bases, true as fwd, ctx as context from windows_{name} where {fwd}
  union all
  select doc_id::varchar, doc_id, start, start + {n}, {_revcomp("w")}, false, {_revcomp("ctx")} from windows_{name} where {rev}
)"""


def targets_sql(nuclease: Enzyme = NGG) -> str:
    return f"{GENOME_SQL}, {sites_sql(nuclease)}, targets as materialized (select bases, least(count(*), 32767)::int as cnt, {_enc('bases', *nuclease.compared)} as enc from sites group by bases)"


SOME_GUIDES = f"select bases, enc from targets where {_DRAW('bases')} % {EVERY} = 0"


def hits_sql(most: int = 4, nuclease: Enzyme = NGG, guides: str = SOME_GUIDES) -> str:
    """Hits by equality of one of ``most + 1`` segments, in the first of which that agrees a pair counts, then the distance."""
    x, n = "xor(g.enc, t.enc)", nuclease.guide
    mm = f"bit_count(({x} | ({x} >> 1)) & {int('01' * n, 2)})"
    ends = [n * k // (most + 1) for k in range(most + 2)]
    part = lambda r, k: f"(({r}.enc >> {2 * (n - ends[k + 1])}) & {4 ** (ends[k + 1] - ends[k]) - 1})"
    same = lambda k: f"{part('g', k)} = {part('t', k)}"
    joins = [
        f"select g.guide_id, g.bases as guide, t.bases, t.cnt, {mm}::int as mm from guides g join targets t on {same(k)} where {mm} <= {most}" + "".join(f" and not {same(j)}" for j in range(k))
        for k in range(most + 1)
    ]
    return f"""{targets_sql(nuclease)}, guides as materialized (select {_enc('bases', 1, nuclease.length)} as guide_id, bases, enc from ({guides})),
hits as materialized ({' union all '.join(joins)})"""


SITES = f"with {GENOME_SQL}, {sites_sql(NGG)} "
TARGETS = f"with {targets_sql()} "
HITS = f"with {hits_sql()} "
PASSAGE_HITS = (
    f"with passages as (select item_id as doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}') as seq from benchmark), "
    + sites_sql(NGG, 0, "first_sites", "passages") + ", "
    + hits_sql(guides=f"select distinct bases, {_enc('bases')} as enc from (select arg_min(bases, start * 2 + (not fwd)::int) as bases from first_sites group by contig_idx)") + " "
)
PLACE = ("contig", "contig_idx", "start", "stop", "fwd")

# Sites.


@query(SITES + "select contig, start::int as start, stop::int as stop, bases, fwd from sites")
def sites_ngg(spark, sf_dir):
    return ngg_sites(spark, sf_dir).select("contig", "start", "stop", "bases", "fwd")


@query(
    f"with {GENOME_SQL}, {', '.join(sites_sql(e, 0, 's_' + e.name.lower()) for e in ENZYMES.values())} "
    + " union all ".join(f"select '{e.name}' as enzyme, fwd, count(*) as n, count(distinct bases) as n_distinct from s_{e.name.lower()} group by fwd" for e in ENZYMES.values())
)
def sites_all_enzymes(spark, sf_dir):
    found = sites.find_sites_of(genome(spark, sf_dir), list(ENZYMES.values()))
    # Counts of one enzyme's distinct bases are merged by key, so the distinct count is a plain one.
    return found.groupBy("enzyme", "fwd", "bases").agg(F.count(F.lit(1)).alias("n")).groupBy("enzyme", "fwd").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query(f"with {GENOME_SQL}, {sites_sql(CPF1)} select contig, start::int as start, stop::int as stop, bases, fwd from sites")
def sites_cpf1(spark, sf_dir):
    return ngg_sites(spark, sf_dir, 0, CPF1).select("contig", "start", "stop", "bases", "fwd")


@query(f"with {GENOME_SQL}, {sites_sql(NGG, 6)} select contig, start::int as start, fwd, bases, context from sites")
def site_context(spark, sf_dir):
    return ngg_sites(spark, sf_dir, 6).select("contig", "start", "fwd", "bases", "context")


_GC = "length(regexp_replace(bases, '[^GC]', '', 'g'))::double / length(bases)"


@query(SITES + f"select contig, start::int as start, fwd, bases, round({_GC}, 6) as gc from sites where {_GC} between 0.4 and 0.6")
def gc_filter(spark, sf_dir):
    kept = sites.gc_filter(ngg_sites(spark, sf_dir), 0.4, 0.6)
    return kept.select("contig", "start", "fwd", "bases", F.round(dna.gc(F.col("bases")), 6).alias("gc"))


@query(SITES + "select concat_ws(chr(9), contig, start, stop, bases, case when fwd then 'F' else 'R' end) as line from sites")
def site_lines(spark, sf_dir):
    return ngg_sites(spark, sf_dir).select(guide_table.site_line(*[F.col(c) for c in ("contig", "start", "stop", "bases", "fwd")]).alias("line"))


@query(SITES + "select contig, start::int as start, stop::int as stop, bases, fwd from sites")
def site_lines_parsed(spark, sf_dir):
    return site_lines(spark, sf_dir).select(*[c.alias(n) for n, c in guide_table.parse_site_line(F.col("line")).items()])


@query(
    SITES + """select contig, start::int as start, fwd, contig_idx < 1048576 as packs,
    case when contig_idx < 1048576 then (((fwd::int)::hugeint << 60) + (23::hugeint << 52) + (contig_idx::hugeint << 32) + start)::bigint end as packed, contig_idx from sites"""
)
def position_pack(spark, sf_dir):
    """Contigs are numbered in 20 bits; beyond them a place has no packed form."""
    rows = ngg_sites(spark, sf_dir)
    packed = dna.pack_position(F.col("contig_idx"), F.col("start"), F.col("stop") - F.col("start"), F.col("fwd"))
    rows = rows.select("contig", "contig_idx", "start", "fwd", packed.alias("packed"))
    back = dna.unpack_position(F.col("packed"))
    read = lambda name: F.coalesce(back[name], F.col(name))
    return rows.select("contig", read("start").cast("int").alias("start"), read("fwd").alias("fwd"), F.col("packed").isNotNull().alias("packs"), "packed", read("contig_idx").alias("contig_idx"))


# Targets.


@query(
    SITES + """select bases, least(count(*), 32767)::int as cnt,
    array_to_string(list_transform((list({'i': contig_idx, 's': start, 'r': not fwd, 'c': contig} order by contig_idx, start, not fwd))[1:32767],
      lambda p: p.c || ':' || p.s || '^' || case when p.r then 'R' else 'F' end), '|') as places from sites group by bases"""
)
def targets_dedupe(spark, sf_dir):
    place = lambda p: F.concat(p["contig"], F.lit(":"), p["start"].cast("string"), F.lit("^"), F.when(p["fwd"], "F").otherwise("R"))
    return ngg_targets(spark, sf_dir, True).select("bases", "cnt", F.array_join(F.transform("positions", place), "|").alias("places"))


@query(TARGETS + "select bases, cnt from targets where cnt between 2 and 20")
def target_count_range(spark, sf_dir):
    return targets.count_range(ngg_targets(spark, sf_dir), 2, 20).select("bases", "cnt")


@query(TARGETS + "select substr(bases, 1, 5) as bin, count(*) as targets, sum(cnt)::bigint as occurrences from targets group by 1")
def bin_histogram(spark, sf_dir):
    return targets.bin_counts(ngg_targets(spark, sf_dir), NGG, 5)


@query(
    "with k as (select unnest(range(0, 16384)) as id) select id::bigint as id, "
    + " || ".join(f"substr('ACGT', ((id >> {2 * (6 - k)}) & 3)::int + 1, 1)" for k in range(7))
    + " as kmer from k"
)
def kmer_enumerate(spark, sf_dir):
    return targets.kmer_table(spark, 7)


@query(TARGETS + f"select bases, {_enc('bases', 1, 23)} as packed, bases as decoded, lpad(bin({_enc('bases', 1, 23)}), 64, '0') as bits, true as accepted from targets")
def encode_decode(spark, sf_dir):
    rows = ngg_targets(spark, sf_dir).select("bases", dna.encode(F.col("bases")).alias("packed"))
    return rows.select("bases", "packed", dna.decode(F.col("packed"), 23).alias("decoded"), dna.bit_string(F.col("packed")).alias("bits"), dna.valid(F.col("bases")).alias("accepted"))


@query(TARGETS + "select bases, translate(bases, 'ACGT', 'TGCA') as complement, reverse(translate(bases, 'ACGT', 'TGCA')) as revcomp, translate(bases, 'ACGT', 'UGCA') as rna from targets")
def revcomp(spark, sf_dir):
    b = F.col("bases")
    return ngg_targets(spark, sf_dir).select("bases", dna.complement(b).alias("complement"), dna.reverse_complement(b).alias("revcomp"), dna.rna_complement(b).alias("rna"))


_SHARE = "(length(bases) - length(replace(bases, '{0}', '')))::double / length(bases)"
_ENTROPY = " + ".join(f"(case when {_SHARE.format(b)} > 0 then -({_SHARE.format(b)}) * log2({_SHARE.format(b)}) else 0 end)" for b in "ACGT")


@query(TARGETS + f"select bases, round({_ENTROPY}, 6) as entropy from targets")
def entropy(spark, sf_dir):
    return ngg_targets(spark, sf_dir).select("bases", F.round(dna.entropy(F.col("bases")), 6).alias("entropy"))


_RUNS = "list_max(list_transform(regexp_extract_all(bases, 'A+|C+|G+|T+'), lambda x: length(x)))"


@query(TARGETS + f"select bases, ({_RUNS})::int as longest from targets")
def homopolymer(spark, sf_dir):
    return ngg_targets(spark, sf_dir).select("bases", dna.homopolymer(F.col("bases")).alias("longest"))


@query(TARGETS + "select '>' || bases || '_' || cnt || chr(10) || bases as record from targets where cnt >= 2")
def extract_fasta(spark, sf_dir):
    kept = fasta.target_records(targets.count_range(ngg_targets(spark, sf_dir), 2))
    return kept.select(F.concat(F.lit(">"), "name", F.lit("\n"), "bases").alias("record"))


@query(TARGETS + f"select bases, cnt from targets where {_DRAW("'1:' || bases")} < {int(0.1 * (1 << 52))}")
def sample(spark, sf_dir):
    return targets.subsample(ngg_targets(spark, sf_dir), 0.1).select("bases", "cnt")


@query(
    f"with {GENOME_SQL}, {sites_sql(NGG)}, one as (select contig_idx from sites group by contig_idx having count(*) = 1) select contig_idx::bigint as contig_idx from one"
)
def unidirectional(spark, sf_dir):
    return sites.unidirectional(genome(spark, sf_dir), NGG, "contig_idx").select("contig_idx")


# Joins.


@query(HITS + "select guide_id, guide, count(*) as n_hits, sum(cnt)::bigint as ot_count from hits group by all")
def hamming_totals(spark, sf_dir):
    return search.by_guide(ngg_hits(spark, sf_dir))


@query(HITS + "select guide_id, guide, bases, cnt, mm from hits")
def hamming_join(spark, sf_dir):
    return ngg_hits(spark, sf_dir).select("guide_id", "guide", "bases", "cnt", "mm")


@query(HITS + "select guide_id, guide, bases, cnt, mm from hits")
def hamming_join_pigeonhole(spark, sf_dir):
    return ngg_hits(spark, sf_dir, "halves").select("guide_id", "guide", "bases", "cnt", "mm")


@query(PASSAGE_HITS + "select guide_id, guide, bases, cnt, mm from hits")
def hamming_scan(spark, sf_dir):
    """Guides of the benchmark, few enough to be compared with every target."""
    return search.discover(passage_guides(spark, sf_dir), ngg_targets(spark, sf_dir), NGG, 4, "scan").select("guide_id", "guide", "bases", "cnt", "mm")


@query(PASSAGE_HITS + "select guide_id, guide, bases, cnt, mm from hits")
def hamming_probe(spark, sf_dir):
    """The same guides by a broadcast of their neighbours' halves; targets are not shuffled for the search."""
    return search.discover(passage_guides(spark, sf_dir), ngg_targets(spark, sf_dir), NGG, 4, "probe").select("guide_id", "guide", "bases", "cnt", "mm")


@query(f"with {hits_sql(3, CPF1)} select guide_id, guide, bases, cnt, mm from hits")
def hamming_join_cpf1(spark, sf_dir):
    return ngg_hits(spark, sf_dir, "auto", 3, CPF1).select("guide_id", "guide", "bases", "cnt", "mm")


@query(HITS + "select guide_id, bases, list_sum(list_transform(range(1, 24), lambda i: (substr(guide, i, 1) <> substr(bases, i, 1))::int))::int as text_mm from hits")
def text_mismatches(spark, sf_dir):
    return ngg_hits(spark, sf_dir).select("guide_id", "bases", dna.text_mismatches(F.col("guide"), F.col("bases")).alias("text_mm"))


@query(
    HITS + """, near as (select h.guide_id, h.guide, g.guide_id as p, g.bases as pb from hits h join guides g on g.bases = h.bases where h.mm > 0)
    select guide_id, guide, string_agg(pb, ',' order by p, pb) as partners from near group by all"""
)
def reciprocal(spark, sf_dir):
    return search.reciprocal(cut(some_guides(ngg_targets(spark, sf_dir)), "guides"), NGG, 4)


_BEDS = "beds as (select doc_id::varchar as contig, (doc_id % 7) * 40 as start, (doc_id % 7) * 40 + 300 as stop, 'r' || doc_id || '_' || k as name, doc_id * 2 + k as idx from documents, (select unnest([0, 1]) as k) where doc_id % 3 = 0 and k <= doc_id % 2)"


@query(
    f"{SITES}, {_BEDS} select s.contig, s.start::int as start, s.fwd, s.bases, coalesce(string_agg(b.name, ',' order by b.idx), 'NA') as regions "
    "from sites s left join beds b on s.contig = b.contig and s.start < b.stop and b.start < s.stop group by all"
)
def bed_overlap(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") % 3 == 0)
    beds = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 2)).alias("k"))
    beds = beds.select(
        F.col("doc_id").cast("string").alias("contig"), (F.col("doc_id") % 7 * 40).alias("start"), (F.col("doc_id") % 7 * 40 + 300).alias("stop"),
        F.concat(F.lit("r"), F.col("doc_id"), F.lit("_"), F.col("k")).alias("name"), (F.col("doc_id") * 2 + F.col("k")).alias("idx"),
    )
    out = intervals.overlap_join(ngg_sites(spark, sf_dir), beds, ["contig", "start", "fwd"], "regions")
    return out.select("contig", "start", "fwd", "bases", "regions")


@query(
    SITES + "select case when contig_idx % 5 = 0 then 'chr' || contig_idx % 3 else contig end as contig, "
    "(start + case when contig_idx % 5 = 0 then contig_idx * 100 else 0 end)::bigint as start, fwd, bases, case when contig_idx % 5 = 0 then contig else 'NA' end as old_contig from sites"
)
def interval_remap(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") % 5 == 0)
    mapping = docs.select(F.col("doc_id").cast("string").alias("old_contig"), F.concat(F.lit("chr"), F.col("doc_id") % 3).alias("contig"), (F.col("doc_id") * 100).alias("start"))
    out = intervals.remap(ngg_sites(spark, sf_dir), mapping)
    return out.select("contig", F.col("start").cast("bigint").alias("start"), "fwd", "bases", "old_contig")


# Aggregates over hits.


def _cut_off_sql(hits: str, limit: int, order: str) -> str:
    before = f"coalesce(sum(cnt) over (partition by guide_id order by {order} rows between unbounded preceding and 1 preceding), 0)"
    return (
        f"with {hits}, o as (select *, {before} as before, sum(cnt) over (partition by guide_id) >= {limit} as overflowed from hits) "
        f"select guide_id, bases, cnt, mm, overflowed from o where before < {limit}"
    )


@query(_cut_off_sql(hits_sql(), LOW_LIMIT, "bases"))
def overflow_cutoff(spark, sf_dir):
    return ngg_hits_until(spark, sf_dir, LOW_LIMIT).select("guide_id", "bases", "cnt", "mm", "overflowed")


@query(_cut_off_sql(hits_sql(), search.MAX_OFF_TARGETS, "bases"))
def overflow_cutoff_default(spark, sf_dir):
    return ngg_hits_until(spark, sf_dir, search.MAX_OFF_TARGETS).select("guide_id", "bases", "cnt", "mm", "overflowed")


@query(_cut_off_sql(hits_sql(3, CPF1), LOW_LIMIT, "substr(bases, 5, 7), bases"))
def overflow_cutoff_cpf1(spark, sf_dir):
    return ngg_hits_until(spark, sf_dir, LOW_LIMIT, 3, CPF1).select("guide_id", "bases", "cnt", "mm", "overflowed")


@query(_cut_off_sql(hits_sql(), LOW_LIMIT, "bases"))
def overflow_of_hits(spark, sf_dir):
    """The cut-off of hits that are there already."""
    return search.overflow(ngg_hits(spark, sf_dir), NGG, LOW_LIMIT).select("guide_id", "bases", "cnt", "mm", "overflowed")


@query(
    HITS + ", d as (select guide_id, guide, length(regexp_replace(guide, '[^GC]', '', 'g'))::double / length(guide) as gc, sum(case when mm = 0 then cnt else 0 end)::bigint as n from hits group by all) "
    "select guide_id, guide, gc < 0.25 or gc > 0.75 as gc_flag, case when contains(substr(guide, 1, 20), 'TTTT') then 'PolyT' else 'NONE' end as poly_t, "
    "case when n > 0 then 'IN_GENOME=' || n else 'NONE' end as in_genome from d"
)
def dangerous_text(spark, sf_dir):
    out = scoring.dangerous(ngg_hits(spark, sf_dir))
    return out.select("guide_id", "guide", F.col("gc").startswith("GC_").alias("gc_flag"), "poly_t", "in_genome")


@query(HITS + "select guide_id, sum(cnt)::bigint as ot_count from hits group by 1")
def ot_totals(spark, sf_dir):
    return search.by_guide(ngg_hits(spark, sf_dir)).select("guide_id", "ot_count")


_HISTOGRAM = " || ',' || ".join(f"sum(case when mm = {k} then cnt else 0 end)" for k in range(5))


@query(HITS + f"select guide_id, guide, {_HISTOGRAM} as histogram from hits group by all")
def mismatch_histogram(spark, sf_dir):
    return scoring.mismatch_histogram(ngg_hits(spark, sf_dir))


@query(
    f"{HITS}, n as (select guide_id, guide, min(case when mm > 0 then mm end) as near from hits group by all) select n.guide_id, n.guide, coalesce(near::varchar, 'UNK') as closest, "
    "coalesce(sum(case when h.mm = near then h.cnt end), 0)::bigint as closest_count from n join hits h using (guide_id) group by n.guide_id, n.guide, near"
)
def closest_hit(spark, sf_dir):
    return scoring.closest_hit(ngg_hits(spark, sf_dir))


@query(
    HITS + "select guide_id, guide, round(length(regexp_replace(guide, '[^GC]', '', 'g'))::double / length(guide), 6) as gc, contains(substr(guide, 1, 20), 'TTTT')::int as poly_t, "
    "sum(case when mm = 0 then cnt else 0 end)::bigint as in_genome from hits group by all"
)
def dangerous(spark, sf_dir):
    return scoring.dangerous(ngg_hits(spark, sf_dir), numeric=True).withColumn("gc", F.round("gc", 6))


def _hsu_sql() -> str:
    diff = lambda i: f"substr(guide, {i}, 1) <> substr(bases, {i}, 1)"
    product = " * ".join(f"(case when {diff(i + 1)} then {1 - w!r}::double else 1.0::double end)" for i, w in enumerate(scoring.HSU_POSITION))
    pam = "case substr(bases, 22, 2) " + " ".join(f"when '{k}' then {v}::double" for k, v in scoring.HSU_PAM.items()) + f" else {scoring.HSU_OTHER_PAM}::double end"
    return f"""{HITS}, d as (select *, {product} as product, {pam} as pam, list_filter(range(1, 21), lambda i: substr(guide, i, 1) <> substr(bases, i, 1)) as places from hits where mm > 0),
    s as (select guide_id, product * pam * 100 * case when len(places) = 0 then 1.0::double else 1.0::double / (len(places) * len(places)) end
      * case when len(places) < 2 then 1.0::double else 1.0::double / (((19 - (places[-1] - places[1])::double / (len(places) - 1)) / 19.0::double) * 4 + 1) end as score from d)
    select guide_id, guide, round(100 / (100 + coalesce((select sum(score) from s where s.guide_id = g.guide_id), 0)) * 100, 6) as hsu2013 from (select distinct guide_id, guide from hits) g"""


@query(_hsu_sql())
def hsu2013(spark, sf_dir):
    return scoring.hsu(ngg_hits(spark, sf_dir)).withColumn("hsu2013", F.round("hsu2013", 6))


def _pair_sql(first: int, last: int, shift: int, extra: str) -> str:
    code = lambda s, i: f"(instr('ACGT', substr({s}, {i}, 1)) - 1)"
    terms = [f"(case when substr(guide, {i}, 1) <> substr(bases, {i}, 1) then w[{(i + shift - 1) * 16} + {code('guide', i)} * 4 + {code('bases', i)} + 1] else 1.0::double end)" for i in range(first, last + 1)]
    weights = ", ".join(f"{w!r}::double" for w in scoring.neutral_weights())
    return f"{HITS}, p as (select guide_id, guide, bases, cnt, mm, {' * '.join(terms)}{extra} as score from hits, (select [{weights}] as w))"


_PAM_SQL = " * (case substr(bases, 22, 2) " + " ".join(f"when '{k}' then {v}::double" for k, v in scoring.CFD_PAM.items()) + " end)"
_OTHER = "substr(guide, 1, 20) <> substr(bases, 1, 20)"


@query(
    _pair_sql(1, 20, 0, _PAM_SQL)
    + f"select guide_id, guide, round(case when max(score) filter (where {_OTHER}) >= 0.023 then max(score) filter (where {_OTHER}) else 0 end, 6) as cfd_max, "
    f"round(1 / (1 + coalesce(sum(score * cnt) filter (where {_OTHER}), 0)), 6) as cfd_specificity from p group by all"
)
def cfd(spark, sf_dir):
    out = scoring.cfd(ngg_hits(spark, sf_dir), scoring.neutral_weights())
    return out.select("guide_id", "guide", F.round("cfd_max", 6).alias("cfd_max"), F.round("cfd_specificity", 6).alias("cfd_specificity"))


@query(
    _pair_sql(2, 20, -1, "")
    + "select guide_id, guide, round(coalesce(max(score) filter (where mm > 0), 0), 6) as crispri_max, round(1 / (1 + coalesce(sum(score * cnt) filter (where mm > 0), 0)), 6) as crispri_specificity from p group by all"
)
def crispri(spark, sf_dir):
    out = scoring.crispri(ngg_hits(spark, sf_dir), scoring.neutral_weights())
    return out.select("guide_id", "guide", F.round("crispri_max", 6).alias("crispri_max"), F.round("crispri_specificity", 6).alias("crispri_specificity"))


def _doench_sql() -> str:
    terms = []
    for key, w in scoring.DOENCH_WEIGHTS.items():
        motif = key.rstrip("0123456789")
        terms.append(f"(case when substr(c, {int(key[len(motif) :]) + 1}, {len(motif)}) = '{motif}' then {w!r}::double else 0 end)")
    gc = "length(regexp_replace(substr(c, 5, 20), '[^GC]', '', 'g'))"
    score = f"{scoring.DOENCH_INTERCEPT!r}::double + (case when {gc} > 10 then ({gc} - 10) * {scoring.DOENCH_GC_HIGH!r}::double else (10 - {gc}) * {scoring.DOENCH_GC_LOW!r}::double end) + {' + '.join(terms)}"
    return f"with {GENOME_SQL}, {sites_sql(NGG, 6)}, c as (select contig, start, fwd, substr(context, 3, 30) as c from sites where context is not null) select contig, start::int as start, fwd, round(1 / (1 + exp(-({score}))), 6) as doench2014 from c"


@query(_doench_sql())
def doench2014(spark, sf_dir):
    rows = ngg_sites(spark, sf_dir, 6).where("context is not null")
    return rows.select("contig", "start", "fwd", F.round(scoring.doench2014(F.col("context")), 6).alias("doench2014"))


_MORENO = " + ".join(f"(case when substr(context, {p}, {len(m)}) = '{m}' then {w!r}::double else 0 end)" for m, p, w in scoring.MORENO_WEIGHTS)


@query(f"with {GENOME_SQL}, {sites_sql(NGG, 6)} select contig, start::int as start, fwd, round({scoring.MORENO_INTERCEPT!r}::double + {_MORENO}, 6) as moreno2015 from sites where context is not null")
def moreno2015(spark, sf_dir):
    rows = ngg_sites(spark, sf_dir, 6).where("context is not null")
    return rows.select("contig", "start", "fwd", F.round(scoring.moreno2015(F.col("context")), 6).alias("moreno2015"))


# Ranks of all targets, over two scores that both engines compute from the target alone.

_SCORED = f"{TARGETS}, scored as (select bases as guide_id, cnt::double as a, (enc % 1009)::double as b, bases from targets)"
_RANK = lambda c, order: f"(rank() over (order by {c} {order}) + count(*) over (partition by {c}) // 2)"
_RANKED = f"{_SCORED}, r as (select *, {_RANK('a', 'desc')} as rank_a, {_RANK('b', 'asc')} as rank_b from scored), m as (select *, (rank_a + rank_b) / 2.0::double as median from r), k as (select *, {_RANK('median', 'asc')} as median_rank, count(*) over () as n from m) "


def _scored(spark, sf_dir):
    rows = ngg_targets(spark, sf_dir)
    return rows.select(F.col("bases").alias("guide_id"), F.col("cnt").cast("double").alias("a"), (F.col("enc") % 1009).cast("double").alias("b"))


def _ranked(spark, sf_dir):
    return ranking.aggregate_ranks(_scored(spark, sf_dir), {"a": True, "b": False})


@query(_RANKED + "select guide_id, rank_a::bigint as rank_a, rank_b::bigint as rank_b from k")
def rank_ties(spark, sf_dir):
    return _ranked(spark, sf_dir).select("guide_id", "rank_a", "rank_b")


@query(_RANKED + "select guide_id, median, median_rank::bigint as median_rank from k")
def median_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("guide_id", "median", "median_rank")


@query(_RANKED + "select guide_id, ceil(median_rank * 4.0::double / n)::bigint as tranche from k")
def tranche(spark, sf_dir):
    return _ranked(spark, sf_dir).select("guide_id", "tranche")


@query(
    f"{TARGETS}, scored as (select bases as guide_id, case when enc % 7 > 0 then cnt else {int(ranking.WORST_HIGH)} end::double as a, case when enc % 5 > 0 then enc % 1009 else {int(ranking.WORST_LOW)} end::double as b from targets), "
    f"r as (select *, {_RANK('a', 'desc')} as rank_a, {_RANK('b', 'asc')} as rank_b from scored), m as (select *, (rank_a + rank_b) / 2.0::double as median from r) "
    f"select guide_id, rank_a::bigint as rank_a, rank_b::bigint as rank_b, {_RANK('median', 'asc')}::bigint as median_rank from m"
)
def rank_missing(spark, sf_dir):
    """A seventh of one score is missing and a fifth of the other is no number; these rank as the worst."""
    rows = ngg_targets(spark, sf_dir).select(
        F.col("bases").alias("guide_id"), F.when(F.col("enc") % 7 > 0, F.col("cnt")).alias("a"), F.when(F.col("enc") % 5 > 0, (F.col("enc") % 1009).cast("string")).otherwise("NA").alias("b")
    )
    return ranking.aggregate_ranks(rows, {"a": True, "b": False}).select("guide_id", "rank_a", "rank_b", "median_rank")


@query(_RANKED + "select guide_id, top_x from (select guide_id, row_number() over (order by median, guide_id) as top_x, n from k) where top_x <= least(ceil(n / 4.0::double), 1000)")
def top_x(spark, sf_dir):
    return _ranked(spark, sf_dir).where("top_x is not null").select("guide_id", "top_x")


# Tokens and rows-only operators.


@query(HITS + "select guide_id, bases || '_' || cnt || '_' || mm as token from hits")
def token_encode(spark, sf_dir):
    return ngg_hits(spark, sf_dir).select("guide_id", guide_table.token(F.col("bases"), F.col("cnt"), F.col("mm")).alias("token"))


@query(HITS + "select guide_id, bases, cnt, mm, cnt as n_places from hits")
def token_roundtrip(spark, sf_dir):
    scores = F.create_map(F.lit("mm"), F.col("mm").cast("string"))
    text = guide_table.token(F.col("bases"), F.col("cnt"), F.col("mm"), F.col("positions"), scores)
    rows = ngg_hits(spark, sf_dir, positions=True).select("guide_id", guide_table.parse_token(text).alias("t"))
    return rows.select("guide_id", "t.bases", "t.cnt", F.col("t.scores")["mm"].cast("int").alias("mm"), F.size("t.positions").alias("n_places"))


@query(
    HITS + ", s as (select guide_id, guide, sum(cnt) as n, string_agg(bases || '_' || cnt || '_' || mm, ',' order by bases) as t from hits group by all) "
    f"select concat_ws(chr(9), 'g', 0, 23, guide, 'NONE', case when n >= {LOW_LIMIT} then 'OVERFLOW' else 'OK' end, 'FWD', n, t) as line from s"
)
def guide_rows(spark, sf_dir):
    return guide_table.guide_lines(_guide_rows(ngg_hits(spark, sf_dir))).withColumnRenamed("value", "line")


def _guide_rows(hits: DataFrame) -> DataFrame:
    token = guide_table.token(F.col("bases"), F.col("cnt"), F.col("mm"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("bases", token.alias("t")))), lambda x: x["t"])
    rows = hits.groupBy("guide_id", "guide").agg(F.sum("cnt").alias("ot_count"), listed.alias("tokens"))
    return rows.select(
        F.lit("g").alias("contig"), F.lit(0).alias("start"), F.lit(23).alias("stop"), F.col("guide").alias("bases"), F.lit(None).cast("string").alias("context"),
        (F.col("ot_count") >= LOW_LIMIT).alias("overflowed"), F.lit(True).alias("fwd"), "ot_count", "tokens",
    )


# Random guides: letters by MD5, which both engines have.


def _letter_sql(slot: str, letters: str) -> str:
    return f"substr('{letters}', ({_DRAW(f"'1:{slot}:' || id")} % {len(letters)})::int + 1, 1)"


def _random_sql(count: int, tokens: list[str], left: int, right: int, one_site: bool) -> str:
    """The ``count`` smallest of 50 times as many ids whose guide is new (and has one site)."""
    around = lambda n, name: [_letter_sql(f"{name}{k}", "ACGT") for k in range(n)]
    body = []
    for k, t in enumerate(tokens):
        one = _letter_sql(t[1:].rstrip("-") or f"own{k}", randoms.IUPAC[next(x[0] for x in tokens if x[1:] == t[1:].rstrip("-")) if t[1:] else t])
        body.append(f"translate({one}, 'ACGT', 'TGCA')" if t.endswith("-") else one)
    seq = " || ".join([*around(left, "l"), *body, "'GG'", *around(right, "r")])
    n = len(tokens) + 2
    fits = " + ".join(f"(substr(seq, {k + 1}, {n}) like '%GG')::int + (substr(seq, {k + 1}, 2) = 'CC')::int" for k in range(left + right + 1))
    good = f"where {fits} = 1" if one_site else ""
    return f"with r as (select id, {seq} as seq from range({50 * count}) t(id)), d as (select min(id)::bigint as id, seq from r {good} group by seq) select id, seq from d order by id limit {count}"


_TOKENS = ["N1", "R", "N2", "N2-", "N1-"] + ["N"] * 16


@query(_random_sql(500, ["N"] * 21, 4, 4, False))
def random_guides(spark, sf_dir):
    return randoms.random_guides(spark, NGG, 500, left=4, right=4)


@query(_random_sql(200, _TOKENS, 0, 0, True))
def patterned_guides(spark, sf_dir):
    return randoms.random_guides(spark, NGG, 200, tokens=",".join(_TOKENS), one_site=True)


@query(_random_sql(300, ["N"] * 21, 0, 0, False).replace("select id, seq from d", "select 'random' || seq as name, seq from d"))
def random_fasta(spark, sf_dir):
    path = scratch_path(spark, "random-fasta")
    rows = randoms.random_guides(spark, NGG, 300)
    fasta.write_fasta(rows.select(F.concat(F.lit("random"), "seq").alias("name"), "seq"), "name", "seq", path)
    return fasta.read_fasta(spark, path).select(F.col("contig").alias("name"), "seq")


# Files: written to the shared folder and read back.


@query(f"with {GENOME_SQL} select 'doc_' || doc_id as contig, length(seq)::bigint as n, md5(seq) as digest from chunked")
def fasta_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    rows = genome(spark, sf_dir).select(F.concat(F.lit("doc "), "contig").alias("name"), F.lower("seq").alias("seq"))
    fasta.write_fasta(rows, "name", "seq", path, "gzip")
    return fasta.read_fasta(spark, path).select("contig", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query(f"with {GENOME_SQL}, {sites_sql(NGG, 6)} select contig, start::int as start, fwd, bases, context from sites")
def fasta_pieces(spark, sf_dir):
    """Sites of a FASTA file of wrapped lines, read by pieces of contigs."""
    path, size = scratch_path(spark, "fasta"), 4096
    rows = genome(spark, sf_dir).select("contig", F.lower(F.regexp_replace("seq", "(.{60})", "$1\n")).alias("seq"))
    fasta.write_fasta(rows, "contig", "seq", path)
    pieces = fasta.read_pieces(spark, path, *sites.halo([NGG], 6), size)
    return sites.find_sites_in(pieces, size, [NGG], 6).select("contig", F.col("start").cast("int").alias("start"), "fwd", "bases", "context")


@query(f"with {GENOME_SQL} select doc_id::varchar as contig, length(seq)::bigint as length from chunked")
def dictionary_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "dict")
    line = F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.length("seq").cast("string"))
    genome(spark, sf_dir).select(line).union(spark.sql("select '@HD\tVN:1.6'")).write.text(path)
    return fasta.read_dictionary(spark, path)


@query(
    "select doc_id::varchar as contig, (doc_id % 7 * 40)::bigint as start, (doc_id % 7 * 40 + 300)::bigint as stop, 'r' || doc_id as name, "
    "case when doc_id % 2 = 0 then source end as source, case when doc_id % 2 = 0 then '1' end as kind from documents"
)
def bed_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "bed")
    start = F.col("doc_id") % 7 * 40
    fields = ["doc_id", start, start + 300, F.concat(F.lit("r"), "doc_id")]
    more = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("source="), "source", F.lit(";kind=1")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select(F.concat_ws("\t", *fields, more)).union(spark.sql("select '#chrom\tstart'")).write.text(path)
    return bed.read_bed(spark, path).select("contig", "start", "stop", "name", F.col("rest")["source"].alias("source"), F.col("rest")["kind"].alias("kind"))


@query(TARGETS + "select bases, cnt, enc, substr(bases, 1, 2) as bin from targets")
def index_linear(spark, sf_dir):
    return ngg_index(spark, sf_dir).targets.select("bases", "cnt", "enc", "bin")


@query(
    TARGETS + "select 0 as half, enc >> 26 as bin, count(*) as targets, sum(cnt)::bigint as occurrences from targets group by all "
    "union all select 1, (enc & 1048575) >> 6, count(*), sum(cnt)::bigint from targets group by all"
)
def index_bins(spark, sf_dir):
    return ngg_index(spark, sf_dir).bins.select("half", "bin", "targets", "occurrences")


@query(
    TARGETS + "select 0 as half, bases, row_number() over (order by enc >> 20, bases) as place from targets "
    "union all select 1, bases, row_number() over (order by enc & 1048575, bases) from targets"
)
def index_order(spark, sf_dir):
    """The place of every target in both sorted copies, as the files hold them."""
    index = ngg_index(spark, sf_dir)
    first, second = (index.places(half).select(F.lit(half).alias("half"), "bases", "place") for half in (0, 1))
    return first.unionByName(second)


@query(f"with {GENOME_SQL} select doc_id::varchar as contig, doc_id as contig_idx, length(seq)::bigint as length from chunked")
def index_contigs(spark, sf_dir):
    return ngg_index(spark, sf_dir).contigs


@query(PASSAGE_HITS + "select guide_id, guide, bases, cnt, mm from hits")
def index_seek(spark, sf_dir):
    """Guides of the benchmark within 4 mismatches, read from what they reach in both copies."""
    return seek.search_index(passage_guides(spark, sf_dir), ngg_index(spark, sf_dir), 4, "seek")


@query(HITS + "select guide_id, guide, bases, cnt, mm from hits")
def index_search(spark, sf_dir):
    """All guides, by the cheaper of reading what they reach and a pass over the index."""
    index = ngg_index(spark, sf_dir)
    return seek.search_index(cut(some_guides(index.targets), "guides"), index)


@query(
    HITS + ", s as (select guide_id, guide, sum(cnt) as n, list({'b': bases, 'c': cnt, 'm': mm} order by bases) as l from hits group by all) "
    "select guide as bases, n::bigint as ot_count, array_to_string(list_transform(list_filter(l, lambda x: x.m <= 2), lambda x: x.b || ' ' || x.c || ' ' || x.m), ',') as kept "
    f"from s where n < {LOW_LIMIT}"
)
def guide_table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "guides")
    guide_table.write_guides(_guide_rows(ngg_hits(spark, sf_dir)), path)
    back = guide_table.read_guides(spark, path, 2)
    kept = F.transform("hits", lambda h: F.concat_ws(" ", h["bases"], h["cnt"], h["mm"]))
    return back.select("bases", "ot_count", F.array_join(kept, ",").alias("kept"))


@query()
def folding(spark, sf_dir):
    return fold.folding(ngg_targets(spark, sf_dir).select("bases"), NGG, 19)


@query(
    _RANKED + ", p as (select guide_id, row_number() over (order by median, guide_id) as place, rank_a + rank_b as s, n from k), b as (select * from p where place <= least(ceil(n / 4.0::double), 1000)), "
    "w as (select x.guide_id, x.s, sum(greatest(0, x.s - y.s)) as score from b x cross join b y group by all) "
    "select guide_id, score::bigint as score, (row_number() over (order by score desc, guide_id) - 1)::bigint as rank from w"
)
def schulze(spark, sf_dir):
    """The best guides, at most a thousand, by widest paths over their two ranks."""
    best = _ranked(spark, sf_dir).where("top_x is not null")
    return ranking.schulze(best, ["rank_a", "rank_b"], "guide_id")
