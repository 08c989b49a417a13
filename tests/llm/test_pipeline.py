import corpus_pipeline
from helixframe.llm import bagminhash, langid, mixing, packing, secrets


def test_stages_follow_each_other(spark, tmp_path):
    assert [f for _, f in corpus_pipeline.STAGES] == [langid.stage, bagminhash.stage, secrets.stage, mixing.stage, packing.stage]
    text = lambda k: " ".join(f"w{(k * 31 + j * j) % 97} the" for j in range(40 + k % 7))
    rows = [(k, text(k), "en", f"s{k % 4}", 0) for k in range(60)]
    rows += [(100, text(3), "en", "s0", 0), (101, "123 456", "en", "s1", 0), (102, None, None, None, 0), (103, "password=c1f6c02f845bf3028d the word " + text(99), "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        step = spark.createDataFrame(step.collect(), docs.schema)
        seen.append({r.doc_id for r in step.collect()})
    assert seen[0] == {r[0] for r in rows} - {101, 102} and 100 not in seen[1] and 3 in seen[1]
    assert step.where("text like '%c1f6c02f845bf3028d%'").count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = packing.pack(step).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in want)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    names = "target taken nth mix_size draw share rep class_id f score length held_out lang_pred".split()
    text = "some words of a text that is long enough to have shingles and a language "
    rows = [(k, f"{text} {k} " * 4, "en", f"s{k % 2}", 0, *[k] * len(names)) for k in range(8)] + [(None, None, None, None, None, *[None] * len(names))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for part in (docs, docs.limit(0)):
        step = part
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, str(tmp_path))
            assert step.columns == docs.columns
        packed = packing.stage(spark, step, str(tmp_path)).collect()
        assert (len(packed) > 0) == (part is docs)
