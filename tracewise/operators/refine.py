"""Enabled labels, strong bisimulation by signature refinement, and quotients. An LTS is an edge table (src, label, dst) and a
state table (pid)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.plans.iterate import HELD, HOT, cut, dealt, discard, hot_keys, ranked, skew_join


def enabled_sets(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(pid, enabled): the sorted distinct labels of each state; deadlocked states have none."""
    some = edges.groupBy(F.col("src").alias("pid")).agg(F.sort_array(F.collect_set("label")).alias("enabled"))
    empty = F.array().cast(some.schema["enabled"].dataType)
    return states.select("pid").join(some, "pid", "left").withColumn("enabled", F.coalesce("enabled", empty))


def enabledness_partitions(edges: DataFrame, states: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """(pid, enabled, class_id): the states by their enabled labels, over all or over ``subset`` (pid). A class is called by its
    least state; it is a key, not a list, so a class may hold any share of the states."""
    sets = enabled_sets(edges, states)
    if subset is not None:
        sets = sets.join(subset.select("pid"), "pid", "left_semi")
    return sets.join(sets.groupBy("enabled").agg(F.min("pid").alias("class_id")), "enabled").select("pid", "enabled", "class_id")


def compare_enabled(p: str, q: str) -> tuple:
    """Whether q's enabled labels are within p's, and whether they contain them (columns of sets)."""
    return F.size(F.array_except(q, p)) == 0, F.size(F.array_except(p, q)) == 0


def post_image(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, label, image): where the states ``q`` of each key's set lead by each label; sorted, distinct."""
    return sets.select("key", F.explode("q").alias("src")).join(edges, "src").groupBy("key", "label").agg(F.sort_array(F.collect_set("dst")).alias("image"))


def signatures(edges: DataFrame, states: DataFrame, part: DataFrame) -> DataFrame:
    """(pid, signature): the sorted distinct (label, class of target) of each state, under a partition (pid, cls)."""
    to = part.select(F.col("pid").alias("dst"), "cls")
    hot = hot_keys(edges, "dst")
    seen = skew_join(edges, to, "dst", hot) if hot.rows else edges.join(to, "dst")
    some = seen.groupBy(F.col("src").alias("pid")).agg(F.sort_array(F.collect_set(F.struct("label", "cls"))).alias("signature"))
    empty = F.array().cast(some.schema["signature"].dataType)
    return states.select("pid").join(some, "pid", "left").withColumn("signature", F.coalesce("signature", empty))


#: Rounds of a plan.
ROUNDS = 4


def _hashes(label: str, c1, c2) -> list:
    return [F.xxhash64(label, c1, c2, F.lit(k)).alias(n) for k, n in ((1, "a"), (2, "b"))]


class _Rounds:
    """Rounds of refinement: a state's class is called by a 128-bit combination, in any order, of the hashes of its distinct (label, class
    of target). So a hot source needs no row for all its edges: its pairs are made distinct and combined where they lie, then by source."""

    def __init__(self, onward: DataFrame, ends: DataFrame) -> None:
        self.onward, self.ends = onward, ends
        parts = int(onward.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        #: Classes have one row for each state; where a partition of them is small, it is held as a hash table.
        self.held = (lambda df: df.hint("shuffle_hash")) if onward.rows + ends.rows <= HELD * parts else (lambda df: df)
        self.to, self.of = hot_keys(onward, "dst"), hot_keys(onward, "src")

    def once(self, named: DataFrame | None) -> DataFrame:
        """(pid, c1, c2) from the classes before; without any, all states with edges are one class, and the targets need not be met."""
        if named is None:
            seen = self.onward.select("src", "label", *[F.lit(1).cast("bigint").alias(c) for c in ("c1", "c2")])
        else:
            classes = named.select(F.col("pid").alias("dst"), "c1", "c2")
            seen = skew_join(self.onward, classes, "dst", self.to) if self.to.rows else self.onward.join(self.held(classes), "dst")
        seen = seen.select("src", *_hashes("label", F.col("c1"), F.col("c2"))).unionByName(self.ends)
        few, hot = seen, None
        if self.of.rows:
            hot = seen.join(F.broadcast(self.of), "src", "left_semi").distinct().groupBy("src").agg(F.bit_xor("a").alias("c1"), F.bit_xor("b").alias("c2"))
            few = seen.join(F.broadcast(self.of), "src", "left_anti")
        # of a source with few edges the pairs meet in one partition, are made distinct and combined there
        made = few.repartition("src").distinct().groupBy("src").agg(F.bit_xor("a").alias("c1"), F.bit_xor("b").alias("c2"))
        return (made if hot is None else made.unionByName(hot)).withColumnRenamed("src", "pid")

    def several(self, named: DataFrame | None) -> DataFrame:
        """(pid, c1, c2, o1, o2): the classes after some rounds, and those before the last of them."""
        for _ in range(ROUNDS):
            before, named = named, self.once(named)
        return named.join(self.held(before.select("pid", F.col("c1").alias("o1"), F.col("c2").alias("o2"))), "pid")


def refine(edges: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(pid, cls): the coarsest strong bisimulation over ``states`` (pid), or those that edges mention; a class is called by its least state.

    Some rounds are one plan, until the last round of one splits no class of the round before it. A round is one join by target and
    one aggregation by source. Deadlocked states are one class from the start: edges that lead to them are combined once for each source.
    Other targets with very many edges meet their class by broadcast, and sources with very many are combined in two steps. Shuffles have as many
    partitions as the edges ask for. The result is written.
    """
    rows = vars(edges).get("rows")  # as ``cut`` has counted
    rows = edges.count() if rows is None else rows
    edges = edges.select("src", "label", "dst")
    edges.rows = rows
    with dealt(edges.sparkSession, rows):
        return cut(_refined(edges, states))


def _refined(edges: DataFrame, states: DataFrame | None) -> DataFrame:
    on = edges.select(F.col("src").alias("dst"), F.lit(True).alias("on")).distinct()
    hot = hot_keys(edges, "dst")
    few = F.broadcast(hot)
    # edges to one target are made distinct where they meet it
    rest = edges.join(few, "dst", "left_anti") if hot.rows else edges
    told = rest.repartition("dst").distinct().join(on, "dst", "left")
    if hot.rows:
        told = told.unionByName(edges.join(few, "dst", "left_semi").distinct().join(F.broadcast(on.join(few, "dst", "left_semi")), "dst", "left"))
    seen = cut(told.select("src", "label", "dst", F.coalesce("on", F.lit(False)).alias("on")), "on")
    live = seen.select(F.col("src").alias("pid")).distinct()
    onward = seen.where("on").select("src", "label", "dst")
    onward.rows = seen.rows
    zero = F.lit(0).cast("bigint")
    ends = seen.where("NOT on").select("src", *_hashes("label", zero, zero)).distinct().groupBy("src").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    rounds = _Rounds(onward, cut(ends))

    named = None
    while True:
        new = cut(rounds.several(named))
        if named is not None:
            discard(named)
        named = new
        split = F.expr("min(c1) <> max(c1) OR min(c2) <> max(c2)").alias("split")
        if not new.groupBy("o1", "o2").agg(split).where("split").limit(1).count():
            break
    named = named.select("pid", F.struct("c1", "c2").alias("cls"))
    least = cut(named.groupBy("cls").agg(F.min("pid").alias("least"), F.count("*").alias("rows")))
    hot = cut(least.where(F.col("rows") > max(1000, new.rows // HOT)).select("cls"))
    names = least.select("cls", "least")
    out = (skew_join(named, names, "cls", hot) if hot.rows else named.join(names, "cls")).select("pid", F.col("least").alias("cls"))
    dead = cut(seen.where("NOT on").select(F.col("dst").alias("pid")).distinct() if states is None else states.select("pid").distinct().join(live, "pid", "left_anti"))
    if dead.rows:
        out = out.unionByName(dead.crossJoin(F.broadcast(dead.agg(F.min("pid").alias("cls")))))  # one row
    return out


def numbered(part: DataFrame) -> DataFrame:
    """(pid, number): classes numbered from 0 by their first state."""
    part = part if "rows" in vars(part) else cut(part)
    least = cut(part.groupBy("cls").agg(F.count("*").alias("rows")))
    names = ranked(least.select("cls"), "cls", "number")
    if least.rows <= HOT:  # few classes: states stay where they lie
        names = F.broadcast(names)
    with dealt(part.sparkSession, part.rows):
        return cut(part.join(names, "cls").select("pid", "number"))


def quotient(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Edges between classes: those of each class's least state, with repeated edges kept."""
    to = part.select(F.col("pid").alias("dst"), F.col("cls").alias("to"))
    own = cut(part.where("pid = cls").select(F.col("pid").alias("src")))
    if own.rows > HOT:
        return edges.join(own, "src", "left_semi").join(to, "dst").select("src", "label", F.col("to").alias("dst"))
    # few classes: neither the edges nor the states are shuffled but those that count
    kept = cut(edges.join(F.broadcast(own), "src", "left_semi"))
    ends = kept.select("dst").distinct()
    if kept.rows <= HOT:
        to = cut(to.join(F.broadcast(ends), "dst", "left_semi"))
    return kept.join(to, "dst").select("src", "label", F.col("to").alias("dst"))
