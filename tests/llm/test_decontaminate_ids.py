from tests.llm.test_decontaminate import ALPHA, ITEM, run

ITEMS = [(None, ITEM), (1, " ".join(ALPHA[20:35])), (None, "short secret item")]
DOCS = [(0, "x " + " ".join(ALPHA[2:14]) + " y"), (1, " ".join(ALPHA)), (2, "a short secret item here"), (3, "nothing of it"), (4, " ".join(ALPHA[24:35]))]
WANT = [(0, 14, 12, ()), (1, 40, 35, ("1",)), (2, 5, 3, ()), (3, 3, 0, ()), (4, 11, 11, ("1",))]


def test_items_without_an_id_hit_words(spark):
    assert run(spark, DOCS, ITEMS) == WANT
    assert run(spark, DOCS, ITEMS, broadcast_bytes=40) == WANT
    assert run(spark, DOCS, [(None, ITEM)]) == [(0, 14, 12, ()), (1, 40, 25, ()), *((i, n, 0, ()) for i, n, _, _ in WANT[2:])]
