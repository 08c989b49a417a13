import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = ["sites_ngg", "site_context", "targets_dedupe", "hamming_join_pigeonhole", "overflow_cutoff", "closest_hit", "cfd", "doench2014", "bed_overlap", "top_x"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["guide_id", "guide", "n_hits", "ot_count"]


@pytest.mark.parametrize("name", CORE)
def test_oracles_agree(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    frame = entry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    shape = lambda rows: sorted(repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns]) for r in rows)
    assert shape(frame.collect()) == shape([dict(zip(names, r)) for r in cursor.fetchall()])
