"""A stream of contigs searched against a fixed target table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.enzymes import Enzyme
from helixframe.operators.search import join_halves
from helixframe.operators.sites import find_sites


def stream_hits(contigs: DataFrame, targets: DataFrame, enzyme: Enzyme, most: int = 4) -> DataFrame:
    """Hits of the sites of streamed ``contigs(contig, contig_idx, seq)``: a stateless stream-static join."""
    sites = find_sites(contigs, enzyme)
    guides = sites.select(F.concat_ws(":", "contig", "start", F.col("fwd").cast("string")).alias("guide_id"), "bases", dna.encode(enzyme.key(F.col("bases"))).alias("enc"))
    return join_halves(guides, targets, enzyme, most)
