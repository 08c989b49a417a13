"""FASTA and sequence-dictionary files; ``.gz`` is read and written by the text source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.scratch import cut

#: Letters of a run of a split, and own letters of a piece.
RUN, PIECE = 1 << 16, 1 << 16


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Contigs (contig, contig_idx, seq) in file order; headers lose ``>``, spaces and tabs become ``_``; bases are upper-cased.

    Records are split off by the reader at ``>``, so a file need not fit one row; a contig does.
    """
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.expr(r"substr(value, instr(value, '\n') + 1)"), r"\s", "")
    rows = rows.select(
        F.translate(head, " \t", "__").alias("contig"),
        F.when(F.col("value").contains("\n"), F.upper(body)).otherwise("").alias("seq"),
        F.monotonically_increasing_id().alias("_order"),
    )
    order = rows.select("_order", F.row_number().over(W.orderBy("_order")).alias("contig_idx"))  # one small row a contig
    return rows.join(order, "_order").select("contig", "contig_idx", "seq")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits in order to runs of letters; a line of ``>`` opens a run that carries its name.

    Lines lie side by side in a batch, so letters between two headers are one slice of it.
    """
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        out = []
        lines = batch.column(0).cast(pa.large_string())
        at = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, lines.offset * 8)
        whole = memoryview(lines.buffers()[2] or b"")
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        heads = pc.starts_with(lines, ">").to_numpy(zero_copy_only=False)
        # Ends of several files may begin at one offset in each and be read by one task.
        of = batch.column(1).dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(heads | np.append(True, (blocks[1:] != blocks[:-1]) | (of[1:] != of[:-1]))).tolist() + [len(lines)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            where, name = (files[a], int(blocks[a])), None
            if heads[a]:
                name = bytes(whole[at[a] + 1 : at[a + 1]]).decode().rstrip("\r").replace(" ", "_").replace("\t", "_")
                a += 1
            letters = bytes(whole[at[a] : at[b]]).translate(None, b" \t\r\x0b\x0c").decode().upper()
            for k in range(0, max(1, len(letters)), RUN):
                seen[where] = seen.get(where, -1) + 1
                out.append((*where, seen[where], name if k == 0 else None, letters[k : k + RUN]))
        if out:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["file", "block", "k", "name", "seq"])


def read_pieces(spark: SparkSession, path: str, before: int, after: int, size: int = PIECE) -> DataFrame:
    """Pieces (contig, contig_idx, size, at, lead, piece) of ``size`` own letters, with up to ``before`` letters before and ``after`` behind them.

    A file's splits are read by as many tasks, wherever a contig begins or ends; only a line is one row.  Runs of letters are numbered inside their
    split, the splits' sums (a row a split) are added up, which gives each run its contig and offset, and runs are then cut
    at the pieces' edges and gathered by piece.  Contigs are numbered from 1 in the order of files and places in them; letters before
    any header are ignored.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    runs = cut(lines.mapInArrow(_runs, "file string, block long, k long, name string, seq string"), "fasta-runs")
    inside = W.partitionBy("file", "block").orderBy("k")
    meta = runs.select("file", "block", "k", "name", F.length("seq").cast("long").alias("n")).withColumn("head", F.count("name").over(inside))
    ahead = W.partitionBy("file", "block", "head").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    meta = meta.withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    last = meta.groupBy("file", "block").agg(F.max("head").alias("heads"))
    tails = meta.join(last, ["file", "block"]).groupBy("file", "block", "heads").agg(F.sum(F.when(F.col("head") == F.col("heads"), F.col("n"))).alias("tail"))
    order = W.orderBy("file", "block")
    splits = tails.withColumn("begun", F.coalesce(F.sum("heads").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    splits = splits.withColumn("since", F.sum("tail").over(W.partitionBy(F.col("begun") + F.col("heads")).orderBy("file", "block")))
    splits = splits.select("file", "block", "begun", F.coalesce(F.lag("since").over(order), F.lit(0)).alias("carried"))
    # A row a split, but splits may be many: joined by what Spark finds cheapest.
    placed = meta.join(cut(splits, "fasta-splits"), ["file", "block"])
    placed = placed.select("file", "block", "k", "name", "n", (F.col("begun") + F.col("head")).alias("contig_idx"), (F.col("offset") + F.when(F.col("head") == 0, F.col("carried")).otherwise(0)).alias("offset"))
    placed = cut(placed.where("contig_idx > 0"), "fasta-placed")
    contigs = placed.groupBy("contig_idx").agg(F.max("name").alias("contig"), F.sum("n").alias("size"))

    run = runs.select("file", "block", "k", "seq").join(placed.select("file", "block", "k", "contig_idx", "offset", "n").where("n > 0"), ["file", "block", "k"])
    # A piece takes what lies from ``before`` letters before to ``after`` behind its own.
    nth = F.sequence(F.greatest(F.lit(0), F.floor((F.col("offset") - after) / size)), F.floor((F.col("offset") + F.col("n") - 1 + before) / size))
    run = run.withColumn("nth", F.explode(nth))
    low = F.greatest(F.col("offset"), F.col("nth") * size - before)
    high = F.least(F.col("offset") + F.col("n"), (F.col("nth") + 1) * size + after)
    parts = run.where(low < high).select("contig_idx", "nth", low.alias("low"), F.substring("seq", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    listed = F.sort_array(F.collect_list(F.struct("low", "part")))
    pieces = parts.groupBy("contig_idx", "nth").agg(listed.alias("parts")).join(contigs, "contig_idx").where(F.col("nth") * size < F.col("size"))
    at = F.col("nth") * size
    return pieces.select(
        "contig", "contig_idx", "size", at.alias("at"), (at - F.col("parts")[0]["low"]).cast("int").alias("lead"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("piece")
    )


def write_fasta(frame: DataFrame, name: str, sequence: str, path: str, compression: str = "none") -> None:
    """Records ``>name`` and sequence, one text file a partition."""
    frame.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence))).write.option("compression", compression).text(path)


def target_records(targets: DataFrame) -> DataFrame:
    """The extract command's records: name ``bases_count`` and bases."""
    return targets.select(F.concat_ws("_", "bases", "cnt").alias("name"), "bases")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Contig names and lengths of ``@SQ`` lines."""
    rows = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length"))
