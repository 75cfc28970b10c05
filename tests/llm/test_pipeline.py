import brute
from llm_rows import SF, docs_table  # noqa: F401

import corpus_pipeline as P
from __spark_entry__ import oracle_sql, queries


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_every_stage_does_what_brute_force_does(spark, tmp_path):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(P.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = written(stage(spark, docs, sf), tmp_path / f"spark-{name}")
        assert docs.columns[: len(names)] == names and (i == 4 or docs.columns == names)
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name == "toxicity":
            gone = {d for d, _ in before} - set(after)
            assert sum(labels.get(d) == 1 for d in gone) > 0.6 * sum(labels.get(d) == 1 for d, _ in before)
            assert sum(labels.get(d) == 0 for d in gone) <= 0.02 * len(before)
        elif name == "line_dedup":
            assert {d: brute.sha(t.encode()) for d, t in after.items()} == {d: k for d, _, _, k in brute.drop_lines(before)}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "simhash_near_dedup":
            assert set(after) == {d for d, _, c in brute.simhash(before) if d == c}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute.decontaminate(before, items) if not r[-1]}
        else:
            assert dict(before) == after and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in docs.collect())


def test_stages_take_nulls_repeats_clashing_columns_and_empty_tables(spark, docs_table):
    texts = brute.invented(5, 20)
    rows = [(None, texts[0]), (None, texts[0]), (1, texts[0]), (1, texts[0]), (2, None), (3, ""), (4, texts[7])]
    docs = docs_table(rows).withColumnRenamed("a", "score").withColumnRenamed("words", "n_dropped")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = sorted((r.doc_id or 0, r.text or "") for r in out.select("doc_id", "text").collect())
        if name == "simhash_near_dedup":
            assert got == sorted({(1, texts[0]), (2, ""), (4, texts[7])})
        elif name != "decontamination":
            assert len(got) == len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_the_pipeline_is_a_query_of_the_whole_table(spark):
    assert "pipeline" in queries() and "pipeline" not in oracle_sql()
    assert queries()["pipeline"](spark, SF).count() > 100
