"""Many edges to one state, and states of few classes: what is large stays where it lies."""

from pyspark.sql import functions as F

from tracewise.operators import refine
from tracewise.plans.equivalence import LTS
from tracewise.plans.iterate import cut


def test_many_edges_to_one_state(spark):
    n = 12000
    edges = cut(spark.range(1, n + 1).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), (F.col("id") % 3).cast("int").alias("label")))
    states = LTS(edges, sparse=True).states
    sig = refine.signatures(edges, states, states.select("pid", F.lit(7).alias("cls")))
    assert "BroadcastHashJoin" in sig._jdf.queryExecution().toString()
    got = {(len(r.signature), r.n) for r in sig.groupBy("signature").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 1), (1, n // 3)}
    part = refine.refine(edges)
    assert {(r.cls, r.n) for r in part.groupBy("cls").agg(F.count("*").alias("n")).collect()} == {(0, 1), (1, n // 3), (2, n // 3), (3, n // 3)}
    assert {tuple(r) for r in refine.quotient(edges, part).collect()} == {(1, 1, 0), (2, 2, 0), (3, 0, 0)}


def test_relation_reads_classes_not_states(spark):
    edges = spark.range(0, 3000).select(F.col("id").alias("src"), (F.col("id") + 10000).alias("dst"), (F.col("id") % 2).cast("int").alias("label"))
    solved = LTS(edges, sparse=True).equivalences()
    rel = solved.relation("traces")
    assert {(r.class_id, r.n) for r in rel.groupBy("class_id").agg(F.count("*").alias("n")).collect()} == {(0, 1500), (1, 1500), (10000, 3000)}
    assert {tuple(r) for r in solved.classes("traces").collect()} == {(0, 1500), (1, 1500), (10000, 3000)}
    assert "BroadcastHashJoin" in rel._jdf.queryExecution().toString() and solved.count_classes("bisimulation") == 3
