"""States of 2^32 and more, as conversations have from the 4096th on."""

import pytest

from tracewise import queries
from tracewise.sources import lts


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("turns"))
    rows = [(5000, 0, "user"), (5000, 1, "assistant"), (4096, 0, "system"), (7, 0, "user")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string").write.parquet(f"{at}/conversations.parquet")
    return at


def test_labels(spark, turns):
    assert {(r.name, r.label) for r in queries.label_dictionary(spark, turns).collect()} == {("i", 0), ("user", 1), ("system", 2), ("assistant", 3)}
    lines = spark.createDataFrame([(0, "4294967296,9223372036854775807,a")], "line long, value string")
    assert [tuple(r) for r in lts.from_lines(lines, lts.LARGEST)[0].collect()] == [(1 << 32, lts.LARGEST, 1)]
    with pytest.raises(lts.ParseError):
        lts.from_lines(lines)
    with pytest.raises(lts.ParseError):
        lts.from_lines(spark.createDataFrame([(0, "0,9223372036854775808,a")], "line long, value string"), lts.LARGEST)


LINES = {((5000 << 20), (5000 << 20) + 1, 1), ((5000 << 20) + 1, (5000 << 20) + 2, 3), ((4096 << 20), (4096 << 20) + 1, 2), ((7 << 20), (7 << 20) + 1, 1)}


def test_edges(spark, turns):
    assert {tuple(r) for r in queries.text_edges(spark, turns).collect()} == LINES


def test_files(spark, turns):
    assert {tuple(r) for r in queries.text_files(spark, turns).collect()} == LINES
