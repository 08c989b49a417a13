"""Command line: ``python -m helixframe index|discover|score|extract|random``; each command runs one job of ``commands``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from helixframe.operators import search
from helixframe.operators.scoring import read_weights
from helixframe.plans import commands

MANY = 2**31 - 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe", description="guide design on Spark")
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("index", help="targets of a reference")
    p.add_argument("--reference", required=True)
    p.add_argument("--database", required=True)
    p.add_argument("--enzyme", default="spCas9ngg")

    p = sub.add_parser("discover", help="guides of a FASTA file and their off-targets")
    p.add_argument("--fasta", required=True)
    p.add_argument("--database", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--positionOutput", action="store_true")
    p.add_argument("--forceLinear", action="store_true", help="compare every guide with every target")
    p.add_argument("--maxMismatch", type=int, default=search.MAX_MISMATCHES)
    p.add_argument("--flankingSequence", type=int, default=6)
    p.add_argument("--maximumOffTargets", type=int, default=search.MAX_OFF_TARGETS)
    p.add_argument("--minGC", type=float, default=0.0)
    p.add_argument("--maxGC", type=float, default=1.0)

    p = sub.add_parser("score", help="scores of a guide table")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--scoringMetrics", required=True, help="names joined by commas")
    p.add_argument("--database", required=True)
    p.add_argument("--maxMismatch", type=int, default=MANY)
    p.add_argument("--includeOTs", action="store_true")
    p.add_argument("--numericOutput", action="store_true")
    p.add_argument("--inputAnnotationBed", default="", help="name:file pairs joined by commas")
    p.add_argument("--transformPositions", default=None, help="BED file of a remap")
    p.add_argument("--shortestGuideEnergy", type=int, default=-1)
    p.add_argument("--maxReciprocalMismatch", type=int, default=1)
    p.add_argument("--cfdWeights", default=None, help="CSV of position, guide, target, weight")
    p.add_argument("--crispriWeights", default=None, help="CSV of position, guide, target, weight")

    p = sub.add_parser("extract", help="targets of a database as FASTA")
    p.add_argument("--binaryOTFile", required=True)
    p.add_argument("--outputFile", required=True)
    p.add_argument("--minInGenome", type=int, default=0)
    p.add_argument("--maxInGenome", type=int, default=MANY)
    p.add_argument("--subsampleProportion", type=float, default=1.0)

    p = sub.add_parser("random", help="random guides as FASTA")
    p.add_argument("--outputFile", required=True)
    p.add_argument("--randomCount", type=int, required=True)
    p.add_argument("--enzyme", required=True)
    p.add_argument("--namePrefix", default="random")
    p.add_argument("--onlyUnidirectional", action="store_true")
    p.add_argument("--sequenceContextLeft", type=int, default=0)
    p.add_argument("--sequenceContextRight", type=int, default=0)
    p.add_argument("--patterned", default=None)
    p.add_argument("--duplicatesAllowed", action="store_true")
    p.add_argument("--maxSuccessiveDesignFailures", type=int, default=50)
    return top


def run(spark: SparkSession, arguments: list[str]) -> None:
    a = parser().parse_args(arguments)
    if a.command == "index":
        commands.build_index(spark, a.reference, a.database, a.enzyme)
    elif a.command == "discover":
        strategy = "linear" if a.forceLinear else "auto"
        commands.discover(spark, a.fasta, a.database, a.output, a.positionOutput, a.maxMismatch, a.flankingSequence, a.maximumOffTargets, a.minGC, a.maxGC, strategy)
    elif a.command == "score":
        beds = dict(pair.split(":", 1) for pair in a.inputAnnotationBed.split(",") if pair)
        weights = {k: read_weights(spark, path) for k, path in (("cfd_weights", a.cfdWeights), ("crispri_weights", a.crispriWeights)) if path}
        commands.score(
            spark, a.input, a.database, a.output, a.scoringMetrics.split(","), a.maxMismatch, a.includeOTs, a.numericOutput,
            beds, a.transformPositions, a.maxReciprocalMismatch, a.shortestGuideEnergy, **weights,
        )
    elif a.command == "extract":
        commands.extract(spark, a.binaryOTFile, a.outputFile, a.minInGenome, a.maxInGenome, a.subsampleProportion)
    else:
        commands.random(
            spark, a.outputFile, a.randomCount, a.enzyme, a.namePrefix, left=a.sequenceContextLeft, right=a.sequenceContextRight, tokens=a.patterned,
            one_site=a.onlyUnidirectional, duplicates=a.duplicatesAllowed, effort=a.maxSuccessiveDesignFailures,
        )


def main(arguments: list[str] | None = None) -> None:
    parser().parse_args(arguments)  # mistakes are told before a session starts
    run(SparkSession.builder.appName("helixframe").getOrCreate(), sys.argv[1:] if arguments is None else arguments)
