"""Common shingles are counted over all texts."""

import numpy as np

from tracewise.llm import jaccard


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 100)
    # 12 of 200 different texts hold one passage, 4 another; copies of a text count once
    texts = [f"w{k} x{k} y{k} z{k} v{k} " + ("the very same five words" if k < 12 else "some other five words here" if k < 16 else "") for k in range(200)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts + texts[14:16] * 20)], "doc_id long, text string").repartition(3)
    got = set(jaccard.common_shingles(docs, "text", 5, 200).tolist())
    of = lambda x: set(jaccard._sets_of([x], 5)[0].tolist())
    assert got == of("the very same five words")
    assert not got & of("some other five words here") and isinstance(np.array(list(got)), np.ndarray)
