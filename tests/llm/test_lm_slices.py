"""How much text is looked up in the shards of a language model at once."""

import pyarrow as pa
from pyspark.sql import types as T

from tracewise.llm import arrowmap, lm


def test_slices_grow_with_the_shards(spark):
    assert [lm.asked_bytes(bits) for bits in (0, 5, 6, 7, 9, 20)] == [1 << 20, 1 << 20, 1 << 20, 2 << 20, 8 << 20, 8 << 20]
    docs = spark.createDataFrame([(k, "x" * (300 << 10)) for k in range(12)], "doc_id int, text string").coalesce(1)
    make = lambda: lambda part: [pa.array([part.num_rows] * part.num_rows, pa.int64())]
    fields = [T.StructField("rows", T.LongType())]
    rows = lambda **most: {r.rows for r in arrowmap.add_columns(docs, "text", fields, make, ["doc_id"], **most).collect()}
    assert rows() == {3}
    assert rows(most=lm.asked_bytes(9)) == {12}


def test_scores_of_many_shards_are_those_of_few(spark):
    docs = spark.createDataFrame([(k, f"a b c {k % 7} d {k % 5} e") for k in range(60)], "doc_id int, text string")
    of = lambda size: {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, lm.train(docs, shard_bytes=size, order=3)).collect()}
    few, many = of(1 << 20), of(20)
    assert few.keys() == many.keys()
    assert all(few[k][:2] == many[k][:2] and abs(few[k][3] - many[k][3]) < 1e-9 for k in few)
