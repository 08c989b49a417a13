from collections import Counter
from hashlib import sha256

import pytest

from helixframe.llm import linededup

SCHEMA = "doc_id long, text string, line_hash string, place int, n_lines string"
UP = str.maketrans(linededup.UPPER, linededup.LOWER)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UP)


def brute(rows, documents, shortest):
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= shortest)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= shortest and held[key(x)] >= documents)]
        out.append((i, len(lines), len(lines) - len(stay), sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def ran(spark, rows, documents, shortest):
    docs = spark.createDataFrame([(i, t, "x", 1, "old") for i, t in rows], SCHEMA)
    out = linededup.dedup_lines(docs, documents, shortest)
    assert out.columns == ["doc_id", "text", "line_hash", "place", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, sha256((r.text or "").encode()).hexdigest()) for r in out.collect()]
    return sorted(got, key=repr)


@pytest.mark.parametrize("documents, shortest", [(10, 1), (3, 1), (2, 4), (1, 1)])
def test_against_plain_python(spark, documents, shortest):
    rows = [(k, f"own {k}\n  Shared LINE \r\n\n\t\n{'É' if k % 2 else 'é'}a\nrep\nrep\n{k % 4}") for k in range(30)]
    rows += [(None, None), (None, "shared line"), (100, ""), (101, "\n\n"), (102, "shared line\nSHARED LINE\x0b"), (103, " shared line"), (104, "Shared line\x00")]
    rows += [(5, "own 5\nx")] * 3 + [(200 + k, "a copy\nof a text") for k in range(40)] + [(300, "long " * 20000 + "\nrep\n" + "\n".join(map(str, range(5000))))]
    assert ran(spark, rows, documents, shortest) == brute(rows, documents, shortest)


def test_a_repeated_line_of_one_document_counts_once(spark):
    rows = [(1, "a\n" * 50), (2, "a")]
    assert {r[0]: r[2] for r in ran(spark, rows, 3, 1)} == {1: 0, 2: 0}


def test_texts_without_dropped_lines_are_untouched(spark):
    docs = spark.createDataFrame([(1, None), (2, "x\r\ny"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == {1: None, 2: "x\r\ny", 3: ""}


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_lines_are_shuffled(spark):
    """Hashes are counted before the exchange, and only hashes and places pass it."""
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = linededup.frequent_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")  # below it, as plans print
