import corpus_pipeline as C

WORDS = [f"w{k}" for k in range(60)]
X, NEAR, CLEAN = " ".join(WORDS), " ".join(["a", *WORDS]), " ".join(f"z{k}" for k in range(60))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    return sorted(C.near_duplicates(spark, docs, "").select("doc_id", "text").collect(), key=repr)


def test_an_id_of_two_groups_stays_in_the_one_it_leads(spark):
    rows = [(3, X, "en"), (5, CLEAN, "en"), (5, NEAR, "en"), (5, CLEAN, "en")]
    assert NEAR < CLEAN and kept(spark, rows) == [(3, X), (5, CLEAN)]


def test_an_id_with_two_texts_is_two_documents(spark):
    other = " ".join(f"y{k}" for k in range(60))
    rows = [(7, CLEAN, "en"), (7, other, "en"), (None, CLEAN, "en"), (None, X, "en"), (None, X, "de"), (0, "z only here today again", "en"), (-2, "z only here today again", "en")]
    assert kept(spark, rows) == sorted([(7, CLEAN), (7, other), (None, X), (-2, "z only here today again")], key=repr)


def test_an_id_with_near_texts_stays_once(spark):
    assert len(kept(spark, [(7, X, "en"), (7, NEAR, "en"), (8, X, "en")])) == 1
