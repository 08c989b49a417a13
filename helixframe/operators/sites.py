"""PAM-adjacent sites of contigs on both strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from helixframe.functions import dna
from helixframe.functions.enzymes import Enzyme

#: Letters of a block, which is dealt to a task, and about how many are scanned at once.
BLOCK, AT_ONCE = 4096, 1 << 21
#: The other strand's letter by letter; what is no base stays.
_BACK = np.arange(256, dtype=np.uint8)
_BACK[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"TGCAtgca", np.uint8)
#: Whether a letter is no base.
_OTHER = np.ones(256, bool)
_OTHER[np.frombuffer(b"ACGT", np.uint8)] = False


def _blocks(contigs: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """Contigs in blocks (contig, contig_idx, size, at, lead, piece): ``piece`` is the block with up to ``before`` letters before it and ``after`` behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, pieces, sizes, held = [], [], [], [], 0
            for k, seq in enumerate(batch.column(2)):
                seq = seq.as_py()
                for at in range(0, len(seq), size):
                    rows.append(k)
                    ats.append(at)
                    sizes.append(len(seq))
                    pieces.append(seq[max(at - before, 0) : at + size + after])
                    held += len(pieces[-1])
                    if held >= 1 << 24:
                        yield out(batch, rows, sizes, ats, pieces)
                        rows, ats, pieces, sizes, held = [], [], [], [], 0
            yield out(batch, rows, sizes, ats, pieces)

    def out(batch, rows, sizes, ats, pieces) -> pa.RecordBatch:
        at = pa.array(ats, pa.int32())
        lead = pa.array([min(a, before) for a in ats], pa.int32())
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), at, lead, pa.array(pieces, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["contig", "contig_idx", "size", "at", "lead", "piece"])

    whole = contigs.select("contig", "contig_idx", "seq")
    numbers = [StructField(x, IntegerType()) for x in ("size", "at", "lead")]
    return whole.mapInArrow(run, StructType([*whole.schema.fields[:2], *numbers, StructField("piece", StringType())]))


def halo(enzymes: list[Enzyme], flank: int = 0) -> tuple[int, int]:
    """Letters that a piece needs before and behind its own."""
    return flank, max(e.length for e in enzymes) - 1 + flank


def find_sites_of(contigs: DataFrame, enzymes: list[Enzyme], flank: int = 0) -> DataFrame:
    """Sites of all ``enzymes`` in one scan of ``contigs(contig, contig_idx, seq)``.

    Returns enzyme, contig, contig_idx, start, stop, bases, fwd, context.  Contigs are cut into blocks that overlap by a
    window and its flanks, and blocks, not contigs, are dealt to tasks.  PAMs are looked for in all pieces of a batch at once,
    so rows are made for sites only; both strands are read off the same letters.  ``context``
    is null where a flank leaves the contig; it may hold letters other than bases.
    """
    before, after = halo(enzymes, flank)
    size = max(BLOCK, 1 << after.bit_length())  # a block's neighbours hold its flanks
    rows = _blocks(contigs.where(F.length("seq") >= min(e.length for e in enzymes)), before, after, size)
    spark = contigs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return find_sites_in(rows.repartition(tasks, "contig_idx", "at"), size, enzymes, flank)


def _strings(letters: np.ndarray, first: np.ndarray, n: int, fwd: bool) -> pa.StringArray:
    """``n`` letters from each place ``first`` on, or their reverse complement."""
    text = letters[first[:, None] + np.arange(n)]
    text = np.ascontiguousarray(text if fwd else _BACK[text][:, ::-1])
    ends = np.arange(len(first) + 1, dtype=np.int32) * n
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(text))


def _wide(pieces: list[str], piece: np.ndarray, first: np.ndarray, n: int, fwd: bool) -> pa.StringArray:
    """The same of pieces whose letters are not one byte each."""
    texts = (pieces[k][a : a + n] for k, a in zip(piece.tolist(), first.tolist()))
    return pa.array(texts if fwd else (t.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1] for t in texts), pa.string())


def _scan(batch: pa.RecordBatch, size: int, e: Enzyme, fwd: bool, flank: int) -> list[pa.Array]:
    """contig, contig_idx, start, stop, bases, fwd and, with a flank, context of the sites of one enzyme on one strand."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    pieces = column("piece").cast(pa.large_string())
    ends = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8)
    letters = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    many = pieces.to_pylist() if len(letters) and letters.max() > 127 else None
    if many is not None:  # a letter is a byte again; those that were not are no bases
        letters = np.frombuffer("".join(many).encode("ascii", "replace"), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in many])])
    begin = ends[:-1] - ends[0]
    sizes, ats, leads = (column(x).to_numpy().astype(np.int64) for x in ("size", "at", "lead"))
    at, pams = e.pam(fwd)
    n = len(letters) - len(pams[0]) + 1
    there = np.zeros(max(n, 0), bool)
    for pam in pams if n > 0 else ():
        same = letters[:n] == ord(pam[0])
        for k, letter in enumerate(pam[1:], 1):
            same &= letters[k : k + n] == ord(letter)
        there |= same
    first = np.flatnonzero(there) - at
    first = first[first >= 0]
    piece = np.searchsorted(begin, first, "right") - 1  # of empty pieces the last begins there, which is not empty or the end
    own = first - begin[piece] - leads[piece]
    start = ats[piece] + own
    other = np.concatenate([[0], np.cumsum(_OTHER[letters], dtype=np.int32)])
    inside = (own >= 0) & (own < np.minimum(size, sizes[piece] - ats[piece])) & (start + e.length <= sizes[piece])
    first, piece, start = first[inside], piece[inside], start[inside]
    clean = other[first + e.length] == other[first]
    first, piece, start = first[clean], piece[clean], start[clean]
    of = pa.array(piece)
    out = [column("contig").take(of), column("contig_idx").take(of), start, start + e.length, _strings(letters, first, e.length, fwd), pa.array(np.full(len(first), fwd))]
    if flank:
        whole = (start >= flank) & (start + e.length + flank <= sizes[piece])
        from_, width = first[whole] - flank, e.length + 2 * flank
        texts = _strings(letters, from_, width, fwd) if many is None else _wide(many, piece[whole], from_ - begin[piece[whole]], width, fwd)
        out.append(texts.take(pa.array(np.cumsum(whole) - 1, mask=~whole)))
    return out


def find_sites_in(rows: DataFrame, size: int, enzymes: list[Enzyme], flank: int = 0) -> DataFrame:
    """The same of pieces (contig, contig_idx, size, at, lead, piece) of ``size`` own letters each, with those of ``halo`` around them."""
    of = {f.name: f for f in rows.schema.fields}
    number = of["at"].dataType
    fields = [StructField("enzyme", StringType()), of["contig"], of["contig_idx"], StructField("start", number), StructField("stop", number), StructField("bases", StringType()), StructField("fwd", BooleanType())]
    fields += [StructField("context", StringType())] if flank else []
    whole = pa.int32() if isinstance(number, IntegerType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few million letters at once.
        step = max(1, AT_ONCE // size)
        for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            for e in enzymes:
                for fwd in (True, False):
                    contig, idx, start, stop, *more = _scan(batch, size, e, fwd, flank)
                    columns = [pa.array([e.name], pa.string()).take(pa.array(np.zeros(len(start), np.int64))), contig, idx, pa.array(start, whole), pa.array(stop, whole), *more]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    found = rows.select("contig", "contig_idx", "size", "at", "lead", "piece").mapInArrow(run, StructType(fields))
    # Without flanks the context is the site.
    return found if flank else found.withColumn("context", F.col("bases"))


def find_sites(contigs: DataFrame, enzyme: Enzyme, flank: int = 0) -> DataFrame:
    """The same for one enzyme: contig, contig_idx, start, stop, bases, fwd, context."""
    return find_sites_of(contigs, [enzyme], flank).drop("enzyme")


def gc_filter(sites: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    if not (0 <= low <= 1 and 0 <= high <= 1):
        raise ValueError("GC limits lie between 0 and 1")
    return sites.where(dna.gc(F.col("bases")).between(low, high))


def unidirectional(frame: DataFrame, enzyme: Enzyme, key: str, sequence: str = "seq") -> DataFrame:
    """Rows whose sequence holds exactly one site, both strands counted; ``key`` is a number that names a row."""
    contigs = frame.select(F.col(key).cast("string").alias("contig"), F.col(key).alias("contig_idx"), F.col(sequence).alias("seq"))
    one = find_sites(contigs, enzyme).groupBy(F.col("contig_idx").alias(key)).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return frame.join(one.select(key), key, "left_semi")
