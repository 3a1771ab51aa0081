from tests.llm.test_langid import rows
from tracewise.llm import langid as L


def test_copies_do_not_crowd_out_texts(spark):
    texts = [t for _, t, _ in rows(600, 5)]
    once = spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string")
    copies = spark.createDataFrame([(t, "aa") for t in texts for _ in range(9)], "text string, lang string").repartition(3)
    (n, sample), (m, copied) = L.fit(once)["aa"], L.fit(copies)["aa"]
    assert sample == copied and m == 9 * n
    assert len(copied) == L.PER_LANGUAGE and len(set(copied)) > 120
