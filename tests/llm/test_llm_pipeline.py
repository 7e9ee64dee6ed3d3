"""The corpus pipeline, stage by stage, on planted documents."""

from test_llm_models import DOCS, planted

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rows, kinds = planted(800)
    passage = "the benchmark asks which of these thirteen words in a row were seen before"
    text_of = {k: rows[k][1] for k in range(800)}
    extra = [(2000, text_of[3], "en", "s", 0, 0), (2000, text_of[3], "en", "s", 0, 0), (2001, text_of[4] + " more", "en", "t", 0, 0),
             (2002, text_of[7] + " " + passage, "en", "t", 0, 0), (2003, None, None, None, None, None), (2004, "12345 6789", "en", "t", 0, 0)]
    docs = spark.createDataFrame(rows + extra, DOCS).withColumnRenamed("kept", "__row")
    spark.createDataFrame([(k, int(kinds[k] != 2), int(kinds[k] == 1)) for k in range(400)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before, kept = {r.doc_id for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= before
        before = kept[name]
    clean = {k for k in range(400, 800) if not kinds[k]}
    assert len(clean & kept["quality"]) > 0.95 * len(clean)
    assert not {k for k in range(400, 800) if kinds[k] == 2} & kept["quality"] and 2003 not in kept["quality"]
    assert 2004 not in kept["language"] and kept["language"] - {2004} == kept["quality"] - {2004}
    assert not {2000, 2001} & kept["near_duplicates"] and {3, 4} & kept["quality"] <= kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["decontamination"] == {2002} & kept["near_duplicates"]
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mixed and all(r.taken == r.repeats * r.size + r.part > 0 for r in mixed)
    assert {r.doc_id for r in mixed} <= kept["decontamination"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_rejects_unknown_languages(spark):
    words = "the house stands near a river and people walk along its green bank every morning".split()
    rows = [(k, " ".join(words[(k + j * 3) % len(words)] for j in range(12)), "en", "s", 0, 7) for k in range(40)]
    rows += [(100, "кот спит на окне и видит сны", None, "s", 0, 7), (101, "xqzv kjwq zzxq vvkq qxjz wqkz the", None, "s", 0, 7),
             (102, "12 34 !", None, "s", 0, 7), (103, rows[0][1], None, "s", 0, 7)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept == {*range(40), 103}
    none = docs.drop("lang").selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, none, "").collect()} == {*range(40), 100, 101, 103}
