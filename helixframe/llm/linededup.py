"""Line deduplication (operator 12): lines that many documents share are dropped everywhere.

All of it is DataFrame code.  A line's key is the line without white space at both ends and with
A-Z lower-cased; its hash is the key's MD5.  A document brings each of its hashes once, so counts of
hashes are counts of documents and are summed before they are shuffled, whatever share of all documents
holds a line.  Which lines a text loses depends on the text alone, so places of dropped lines are kept by
the MD5 of the text: copies agree, whatever their ids are, and lines' texts are never shuffled.

Nulls and edge cases: a null or empty text is one empty line; a text whose lines all go becomes empty;
lines end at \n alone, so a \r before it is white space of its line; a row is a document, so repeated rows
and rows of one id count one by one; null ids stay; an empty table gives an empty result; other columns
stay whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import cut, table, unused

DOCUMENTS, SHORTEST = 10, 1
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of the six white-space characters, A-Z lower-cased and no other letter changed."""
    bare = F.btrim(line, F.lit(SPACE))
    # lower() is fast and the same thing where all characters are ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, shortest: int) -> Column:
    """The hash of each line, null for keys of under ``shortest`` code points."""

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= shortest, F.unhex(F.md5(key)))

    return F.transform(lines_of(text), hashed)


def frequent_lines(docs: DataFrame, documents: int = DOCUMENTS, shortest: int = SHORTEST) -> DataFrame:
    """line_hash and n_documents of all keys that at least ``documents`` documents hold."""
    own = docs.select(F.explode(F.array_distinct(F.array_compact(line_hashes(F.col("text"), shortest)))).alias("line_hash"))
    return own.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_documents")).where(F.col("n_documents") >= documents)


def dedup_lines(docs: DataFrame, documents: int = DOCUMENTS, shortest: int = SHORTEST) -> DataFrame:
    """The documents with their texts put together again from the lines that stay, and two more columns, n_lines and n_dropped.

    Columns of these two names are replaced.
    """
    frequent = cut(frequent_lines(docs, documents, shortest).select("line_hash"), "frequent-lines")
    places = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_hash"), F.posexplode(line_hashes(F.col("text"), shortest)).alias("place", "line_hash"))
    dropped = places.where("line_hash is not null").join(frequent, "line_hash", "left_semi")
    # Copies of a text bring the same places, which are merged before the shuffle.
    dropped = cut(dropped.groupBy("text_hash").agg(F.collect_set("place").alias("dropped")), "dropped-lines")

    whole = unused(docs, "line_row")
    names = {n: unused(docs, n) for n in ("line_text_hash", "line_dropped", "line_all", "line_kept")}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*kept).alias(whole), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias(names["line_text_hash"]))
    rows = rows.join(dropped.select(F.col("text_hash").alias(names["line_text_hash"]), F.col("dropped").alias(names["line_dropped"])), names["line_text_hash"], "left")
    rows = rows.withColumn(names["line_all"], lines_of(F.col("text")))
    lines, gone = F.col(names["line_all"]), F.coalesce(names["line_dropped"], F.array().cast("array<int>"))
    # Places that stay, in order; a set difference of numbers is linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col(names["line_dropped"]).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    rows = rows.select(whole, text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
    back = [F.col("text") if c == "text" else F.col(whole).getField(c).alias(c) for c in order]
    return rows.select(*back, "n_lines", "n_dropped")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (
  select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as place from d
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key from l
), f as (
  select key from k where length(key) >= {SHORTEST} group by key having count(distinct r) >= {DOCUMENTS}
), m as (
  select k.*, f.key is not null as gone from k left join f using (key)
)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from m group by r
"""
