import corpus_pipeline as C
from tests.llm.test_pipeline import corpus


def test_string_ids_and_clashing_columns(spark, tmp_path):
    """The stages before packing keep ids of any type and all columns; the rows are those of number ids."""
    rows, items = corpus()
    rows = [r for r in rows if r[0] is not None][:60]
    more = ["key", "__key", "r", "c0", "found", "hit_items", "lang_pred", "x.y"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ends = []
    for kind, name in (("long", lambda i: i), ("string", lambda i: f"d{i:06}")):
        schema = f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"`{m}` string" for m in more)
        docs = spark.createDataFrame([(name(i), t, g, "s", 1, *more) for i, t, g in rows], schema)
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        assert all([r[m] for m in more] == more for r in got)
        ends.append(sorted(((r.doc_id, r.text) for r in got), key=repr))
    assert sorted((f"d{i:06}", t) for i, t in ends[0]) == sorted(ends[1])
    assert 0 < len(ends[0]) < len(rows)


def test_rows_that_are_all_null(spark, tmp_path):
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
