import random

from tracewise.llm import langid as L

SYLLABLES = {"aa": ["tion", "the", "er", "ing", "and"], "bb": ["ung", "sch", "ein", "der", "ü"], "cc": ["eau", "que", "é", "les", "oi"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(["aa", "aa", "aa", "bb", "cc"])
        out.append((k, text(lang, rng.randint(5, 80), rng), lang))
    return out


def test_held_out_accuracy(spark):
    train = spark.createDataFrame([*rows(400, 1), (900, None, "aa"), (901, "xx yy", None), (902, "...", "bb"), (903, "", "zz")], "doc_id long, text string, lang string")
    test = rows(200, 2)
    model = L.fit(train)
    assert set(model) == {"aa", "bb", "cc"} and all(len(t) <= L.PER_LANGUAGE for _, t in model.values())
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(test, "doc_id long, text string, score string"), model).collect()}
    assert sum(got[k].lang_pred == g for k, _, g in test) >= 198
    assert sum(got[k].accepted for k, _, _ in test) >= 190
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    model = L.fit(spark.createDataFrame(rows(300, 1), "doc_id long, text string, lang string"))
    texts = [None, "", " 12 ... 3_4 ²", "tion the", "a", "the and ing " * 20000, "mixed THE AND ING 123", "漢字"]
    got = L.identify(spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score, r.accepted) for r in got[:8]] == [(r.lang_pred, r.score, r.accepted) for r in got[8:]]
    assert all((r.lang_pred, r.score, r.accepted) == ("und", 0.0, False) for r in got[:3])
    assert [got[k].lang_pred for k in (3, 5, 6)] == ["aa"] * 3
    assert all(r.lang_pred in SYLLABLES for r in got[3:8])


def by_hand(samples, raw):
    """(language, margin) of lower-cased letters with blanks between, by plain use of the library."""
    import zstandard as Z

    params = Z.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=3, min_match=3, target_length=32, strategy=Z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    filler, codes = b" " + bytes(64), []
    for lang in sorted(samples, key=lambda g: (-samples[g][0], g)):
        book = " ".join("".join(c if c.isalpha() else " " for c in t.lower()) for t in samples[lang][1])
        code = Z.ZstdCompressor(dict_data=Z.ZstdCompressionDict(" ".join(book.split()).encode(), dict_type=Z.DICT_TYPE_RAWCONTENT), compression_params=params)
        size = lambda x, code=code: len(code.compress(x + filler)) - len(code.compress(filler))
        codes.append((sum(size(raw[a : a + 8192]) for a in range(0, len(raw), 8192)), len(codes), lang))
    codes.sort()
    return codes[0][2], (codes[1][0] - codes[0][0]) / codes[1][0]


def test_same_as_by_hand(spark):
    model = L.fit(spark.createDataFrame(rows(300, 1), "doc_id long, text string, lang string"))
    test = rows(50, 3) + [(99, text("bb", 4000, random.Random(1)), "bb")]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(test, "doc_id long, text string, l string"), model).collect()}
    for k, t, _ in test:
        lang, margin = by_hand(model, " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()).encode())
        assert got[k].lang_pred == lang and abs(got[k].score - max(0.0, margin)) < 1e-12 and got[k].accepted == (max(0.0, margin) >= L.MIN_MARGIN)


def test_excerpts_come_from_whole_texts(spark):
    long = [(k, "x" * 5000 + " " + text("aa", 2000, random.Random(k)), "aa") for k in range(60)]
    (_, texts) = L.fit(spark.createDataFrame(long, "doc_id long, text string, lang string"))["aa"]
    whole = [t for _, t, _ in long]
    assert all(len(t) == L.EXCERPT and any(t in w for w in whole) for t in texts) and sum("x" * 50 not in t for t in texts) > 20


def test_narrow_margins_are_rejected(spark):
    model = L.Compressors(L.fit(spark.createDataFrame(rows(400, 1), "doc_id long, text string, lang string")), 0.05)
    rng = random.Random(8)
    mixed = [" ".join(text(g, 1, rng) for _ in range(60) for g in ("aa", "bb")) for _ in range(40)]
    clean = [text(g, 120, rng) for _ in range(13) for g in ("aa", "bb", "cc")]
    assert sum(not model.predict(t)[2] for t in mixed) > 20 and all(model.predict(t)[2] for t in clean)


def test_query_learns_from_the_other_rows_only(spark, tmp_path):
    import zlib

    from tracewise.llm import queries

    wrong = {"aa": "bb", "bb": "cc", "cc": "aa"}
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    made = [(k, t, wrong[g] if held(k) else g) for k, t, g in rows(400, 5)]
    spark.createDataFrame([*made, (None, "tion the", "aa"), (9001, None, "aa")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 402 and not got[None].held_out and got[9001].lang_pred == "und"
    for k, _, g in made:
        assert got[k].held_out == held(k)
        assert got[k].lang_pred == ({b: a for a, b in wrong.items()}[g] if held(k) else g)


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit(none)
    assert model == {}
    assert [(r.lang_pred, r.accepted) for r in L.identify(spark.createDataFrame([("abc",)], "text string"), model).collect()] == [("und", False)]
    assert L.identify(none, model).collect() == []
