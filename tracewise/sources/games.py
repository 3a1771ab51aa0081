"""Sources and sinks of energy games: JSON documents, generated games."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.functions.energy import ONE_DIMENSION, STANDARD, EnergyConf
from tracewise.operators.build import Game
from tracewise.operators.solve import from_tables
from tracewise.plans.iterate import cut, discard, followed, ranked, union_all

#: The lists of a document, and how deep their values lie.
LISTS = {"adj": 2, "weights": 3, "attacker_pos": 1}
#: The numbers of a document's configuration.
NUMBERS = ["elements", "max"]


def _running(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (file, start, id, ..) with ``columns`` replaced by their sums up to each row: within splits, and a sum before each split."""
    before = Window.orderBy(F.length("file"), "file", "start").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = rows.groupBy("file", "start").agg(*[F.sum(c).alias(c) for c in columns])
    splits = splits.select("file", "start", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns])
    summed = rows.withColumns({c: F.sum(c).over(within) for c in columns}).join(splits, ["file", "start"])
    return summed.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in columns}).drop(*[f"{c}_before" for c in columns])


def from_json(spark: SparkSession, path: str) -> Game:
    """A game of a JSON document ``{"conf": {"elements": .., "max": ..}, "adj": [[..], ..], "weights": [[[..], ..], ..], "attacker_pos": [..]}``,
    its fields in any order, one file or a folder of the pieces of one; lists that don't fit together raise ValueError.

    The document is cut after each comma and read in any number of splits. A piece holds one value at most, after the brackets that open before it
    and before those that close after it; depth, node and edge are numbers of brackets and values in its split and the splits before. The k-th
    target belongs to the k-th update."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    times = lambda c: F.length("value") - F.length(F.replace("value", F.lit(c), F.lit("")))
    text = F.regexp_replace(F.substring_index("value", ":", -1), r"[\[\]{}\s]", "")
    read = spark.read.text(path, lineSep=",").select("value", *meta, F.monotonically_increasing_id().alias("id"))
    pieces = cut(read.select(F.regexp_extract("value", r'(?s).*"(\w+)"\s*:', 1).alias("key"), text.alias("text"), times("[").alias("opened"), times("]").alias("closed"), "file", "start", "id"))

    at = F.struct(F.length("file").alias("n"), F.col("file").alias("file"), F.col("start").alias("start"), F.col("id").alias("id"))
    heads = pieces.where(F.col("key").isin(*LISTS, *NUMBERS)).groupBy("key").agg(F.count("*").alias("rows"), F.min(at).alias("at"), F.min("text").alias("text")).collect()  # a row for each field
    heads = {r.key: r for r in heads}
    if len(heads) < len(LISTS) + len(NUMBERS) or any(r.rows > 1 for r in heads.values()) or not all(heads[k].text.isdigit() for k in NUMBERS):
        raise ValueError("the document holds no game")
    conf = EnergyConf(*[int(heads[k].text) for k in NUMBERS])
    field = F.lit(None)
    for key, head in sorted(heads.items(), key=lambda h: tuple(h[1]["at"])):
        since = F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(head["at"], ("int", "string", "bigint", "bigint"), ("n", "file", "start", "id"))])
        field = F.when(at >= since, F.lit(key)).otherwise(field)

    rows = _running(pieces.withColumn("field", field).where(F.col("field").isin(*LISTS)).withColumn("depth", F.col("opened") - F.col("closed")), ["depth"])
    top = F.col("depth") + F.col("closed")
    opens = lambda level: (top - F.col("opened") < level) & (top >= level)
    known = F.create_map(*[F.lit(x) for pair in LISTS.items() for x in pair])
    fits = F.when(F.col("text") == "", top <= known[F.col("field")]).otherwise((top == known[F.col("field")]) & F.col("text").rlike(r"^(-?\d{1,18}|true|false)$") & (F.col("text").isin("true", "false") == (F.col("field") == "attacker_pos")))
    holds = F.col("text") != ""
    counted = {"nodes": (F.col("field") == "adj") & opens(2), "edges": (F.col("field") == "adj") & holds, "w_nodes": (F.col("field") == "weights") & opens(2), "w_edges": (F.col("field") == "weights") & opens(3), "owners": (F.col("field") == "attacker_pos") & holds}
    rows = rows.select("field", "text", "file", "start", "id", (fits & (F.col("depth") >= 0)).alias("fits"), opens(3).alias("begins"), (F.col("opened") - F.col("closed")).alias("net"), *[c.cast("bigint").alias(k) for k, c in counted.items()])
    told = rows.agg(F.count_if(~F.col("fits")).alias("misfits"), F.sum("net").alias("net"), *[F.sum(k).alias(k) for k in counted]).first()
    if told.misfits or told.net:
        raise ValueError("the document holds no game")
    for lost, text in ((told.w_nodes != told.nodes, "weights has another length than adj"), (told.owners != told.nodes, "attacker_pos has another length than adj"), (told.w_edges != told.edges, "a node has other numbers of edges and weights")):
        if lost:
            raise ValueError(text)

    rows = cut(_running(rows, list(counted)))
    discard(pieces)
    targets = rows.where((F.col("field") == "adj") & holds).select(F.col("edges").alias("edge"), (F.col("nodes") - 1).alias("src"), F.col("text").cast("bigint").alias("dst"))
    number = F.when(holds, F.struct(at.alias("at"), F.col("text").cast("bigint").alias("u")))
    updates = rows.where((F.col("field") == "weights") & (holds | F.col("begins"))).groupBy(F.col("w_edges").alias("edge")).agg(F.min("w_nodes").alias("node"), F.sort_array(F.collect_list(number))["u"].alias("upd"))
    moves = cut(targets.join(updates, "edge").select("src", "dst", "upd", (F.col("node") - 1).alias("node")))
    if moves.where("src <> node").limit(1).count():
        raise ValueError("a node has other numbers of edges and weights")
    if moves.where((F.col("dst") < 0) | (F.col("dst") >= told.nodes)).limit(1).count():
        raise ValueError("an edge leads to no node")
    positions = rows.where((F.col("field") == "attacker_pos") & holds).select((F.col("owners") - 1).alias("pos"), (F.col("text") == "true").alias("is_attack"))
    return from_tables(positions, moves.select("src", "dst", "upd"), conf)


def write_json(game: Game, path: str) -> None:
    """Writes a game whose positions are 0 to n - 1 as one JSON document in pieces: the part files of the folder, one after the other in the order of
    their names, are the document. A node's moves are sorted by target and update. Other positions raise ValueError.

    A line is the beginning of a field or of a node's list, or a value, and the line after it tells what must follow, so no list is ever held whole."""
    n = game.positions.agg(F.count("*").alias("rows"), F.countDistinct("pos").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b")).first()
    ends = game.moves.agg(F.min(F.least("src", "dst")).alias("a"), F.max(F.greatest("src", "dst")).alias("b")).first()
    if n.rows != n.n or (n.n and (n.a != 0 or n.b != n.n - 1)) or (ends.a is not None and (ends.a < 0 or ends.b >= n.n)):
        raise ValueError("positions must be 0 to n - 1, each once, and moves between them")
    order = ["field", "pos", "kind", "dst", "upd"]
    row = lambda field, text, kind, pos=-1, dst=0, upd="": [F.lit(v).cast(t).alias(k) for k, v, t in zip(order, (field, pos, kind, dst, upd), ("int", "bigint", "int", "bigint", "string"))] + [F.lit(text).alias("text")]
    one, nodes, moves = game.positions.sparkSession.range(1), game.positions, game.update_data().withColumn("upd", F.to_json("upd"))
    conf = f'{{"conf":{{"elements":{game.conf.elements},"max":{game.conf.max}}}'
    lines = [one.select(*row(k, text, 0)) for k, text in enumerate((conf + ',"adj":[', '],"weights":[', '],"attacker_pos":[', "]}"))]
    lines += [nodes.select(*row(k, "[", 1, F.col("pos"))) for k in (0, 1)] + [nodes.select(*row(2, F.col("is_attack").cast("string"), 1, F.col("pos")))]
    lines += [moves.select(*row(k, text, 2, F.col("src"), F.col("dst"), F.col("upd"))) for k, text in ((0, F.col("dst").cast("string")), (1, F.col("upd")))]
    after = F.col("after.kind")
    closed = F.when(after == 2, F.when(F.col("kind") == 2, ",").otherwise("")).when(after == 1, "],").otherwise("]")
    then = F.when(F.col("kind") == 0, "").when(F.col("field") == 2, F.when(after == 1, ",").otherwise("")).otherwise(closed)
    told = followed(union_all(lines), order, ["kind"], "after").withColumn("value", F.concat("text", then))
    # of equal moves those with a comma after them come first
    told.repartitionByRange(*order).sortWithinPartitions(*order, "value").select("value").write.mode("overwrite").text(path)


def to_json(game: Game) -> DataFrame:
    """One row (json) of a game whose positions are 0 to n - 1. For games that fit a document."""
    rows = game.update_data().withColumnRenamed("upd", "weights").groupBy(F.col("src").alias("pos")).agg(F.sort_array(F.collect_list(F.struct("dst", "weights"))).alias("m"))
    rows = game.positions.select("pos", "is_attack").join(rows, "pos", "left")
    none = F.array().cast("array<struct<dst: bigint, weights: array<int>>>")
    all_ = rows.agg(F.sort_array(F.collect_list(F.struct("pos", "is_attack", F.coalesce("m", none).alias("m")))).alias("all"))
    conf = F.struct(F.lit(game.conf.elements).alias("elements"), F.lit(game.conf.max).cast("bigint").alias("max"))
    parts = [F.transform("all", lambda r: F.transform(r["m"], lambda m: m["dst"])).alias("adj"), F.transform("all", lambda r: F.transform(r["m"], lambda m: m["weights"])).alias("weights"), F.transform("all", lambda r: r["is_attack"]).alias("attacker_pos")]
    return all_.select(F.to_json(F.struct(conf.alias("conf"), *parts)).alias("json"))


def random_tables(spark: SparkSession, nodes: int = 100, seed: int = 0, conf: EnergyConf = STANDARD) -> Game:
    """``random_game`` of any size as tables. Random numbers are hashes of the seed, the node and what they are for, so the game is the
    same however it is dealt to tasks, and no task holds more than its own nodes."""
    draw = lambda what, below: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(what)), below).cast("bigint")
    element, k = draw("element", F.lit(conf.elements)), draw("least", F.lit(conf.elements)) + 1
    kind = F.when(draw("kind", F.lit(2)) == 0, F.lit(-1)).otherwise(k.cast("int"))
    upd = F.array(*[F.when(element == i, kind).otherwise(F.lit(0)) for i in range(conf.elements)])
    moves = spark.range(1, max(1, nodes)).select(draw("parent", F.col("id")).alias("src"), F.col("id").alias("dst"), upd.alias("upd"))
    positions = spark.range(nodes).select(F.col("id").alias("pos"), (draw("owner", F.lit(2)) == 0).alias("is_attack"))
    return Game(positions, moves, None, conf)


def random_game(nodes: int = 100, seed: int = 0, conf: EnergyConf = STANDARD) -> dict:
    """A document of a random recursive tree, edges to the root reversed, each with one element that is decremented or, as often,
    taken to the minimum with some element; owners by coin."""
    rng = random.Random(seed)
    adj: list[list[int]] = [[] for _ in range(nodes)]
    weights: list[list[list[int]]] = [[] for _ in range(nodes)]
    for child in range(1, nodes):
        parent = rng.randrange(child)
        u = [0] * conf.elements
        u[rng.randrange(conf.elements)] = -1 if rng.random() < 0.5 else rng.randint(1, conf.elements)
        adj[parent].append(child)
        weights[parent].append(u)
    return {"conf": {"elements": conf.elements, "max": conf.max}, "adj": adj, "weights": weights, "attacker_pos": [rng.random() < 0.5 for _ in range(nodes)]}


# games over the tables of a warehouse


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _position(pos, attacker: bool):
    return F.struct(pos.cast("bigint").alias("pos"), F.lit(attacker).alias("is_attack"))


def _only(*elements) -> list:
    """An update of whole length that decrements the given element (a column, from 0), or nothing."""
    return F.array(*[F.when(elements[0] == i, -1).otherwise(0) if elements else F.lit(0) for i in range(STANDARD.elements)])


def order_game(spark: SparkSession, sf_dir: str) -> Game:
    """Customers (defenders, custkey * 4 + 1) must win each of their orders (attackers, orderkey * 4 + 2); an order is won at any of its items
    (defenders without moves, (orderkey * 8 + linenumber) * 4 + 3). The update to an item is its own: the digits to base 8 of
    orderkey * 31 + partkey, less one, so there are about as many different updates as items."""
    customers = _table(spark, sf_dir, "customer").select(_position(F.col("c_custkey").cast("bigint") * 4 + 1, False).alias("x")).select("x.*")
    orders = _table(spark, sf_dir, "orders").select((F.col("o_custkey").cast("bigint") * 4 + 1).alias("src"), (F.col("o_orderkey").cast("bigint") * 4 + 2).alias("dst"))
    digits = F.col("l_orderkey").cast("bigint") * 31 + F.col("l_partkey").cast("bigint")
    upd = F.array(*[(F.floor(digits / 8**i) % 8 - 1).cast("int") for i in range(STANDARD.elements)])
    item = (F.col("l_orderkey").cast("bigint") * 8 + F.col("l_linenumber").cast("bigint")) * 4 + 3
    items = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey").cast("bigint") * 4 + 2).alias("src"), item.alias("dst"), upd.alias("upd"))
    positions = customers.unionByName(orders.select(_position(F.col("dst"), True).alias("x")).select("x.*")).unionByName(items.select(_position(F.col("dst"), False).alias("x")).select("x.*").distinct())
    return from_tables(positions, orders.withColumn("upd", _only()).unionByName(items), STANDARD)


def diamond_game(rows: DataFrame, first, a, b, c) -> Game:
    """For each row a diamond at positions ``first`` to ``first`` + 3: a defender to two attackers, decrementing elements a and b, and they to the
    end, the second decrementing c."""
    at = lambda k: (first + k).cast("bigint")
    moves = [(0, 1, _only(a)), (0, 2, _only(b)), (1, 3, _only()), (2, 3, _only(c))]
    made = rows.select(F.explode(F.array(*[F.struct(at(s).alias("src"), at(d).alias("dst"), u.alias("upd")) for s, d, u in moves])).alias("m")).select("m.*")
    positions = rows.select(F.explode(F.array(*[_position(at(k), k in (1, 2)) for k in range(4)])).alias("x")).select("x.*")
    return from_tables(positions, made, STANDARD)


def part_game(spark: SparkSession, sf_dir: str) -> Game:
    """A diamond for each part."""
    k = F.col("p_partkey").cast("bigint")
    return diamond_game(_table(spark, sf_dir, "part"), k * 4, F.col("p_size") % 6, k % 6, F.floor(k / 6) % 6)


def supplier_game(spark: SparkSession, sf_dir: str) -> Game:
    """A diamond for each supplier, at positions from 0 on in the order of keys."""
    k = F.col("s_suppkey").cast("bigint")
    return diamond_game(ranked(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "place"), F.col("place") * 4, F.col("s_nationkey") % 6, k % 6, F.floor(k / 6) % 6)


def ladder_game(spark: SparkSession, sf_dir: str) -> Game:
    """A ladder for each supplier: attackers suppkey * 8 + rung, up to 3 rungs by nation, each decrementing the element (suppkey + rung) % 6 on
    the way to the next, and the end."""
    k, rungs = F.col("s_suppkey").cast("bigint"), F.col("s_nationkey").cast("bigint") % 3 + 1
    rows = _table(spark, sf_dir, "supplier").select(k.alias("k"), rungs.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), rungs)).alias("r"))
    positions = rows.select((F.col("k") * 8 + F.col("r")).alias("pos"), (F.col("r") < F.col("n")).alias("is_attack"))
    moves = rows.where("r < n").select((F.col("k") * 8 + F.col("r")).alias("src"), (F.col("k") * 8 + F.col("r") + 1).alias("dst"), _only((F.col("k") + F.col("r")) % 6).alias("upd"))
    return from_tables(positions, moves, STANDARD)


def least_cost_game(spark: SparkSession, sf_dir: str) -> Game:
    """A game of one number: customers are attackers (custkey + 1) and lead to the next one, each fifth to the end (0, a defender) instead; a
    step costs one, or nothing for customers whose balance is below zero."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), (F.col("c_acctbal") < 0).alias("free"))
    to = F.when(F.col("k") % 5 == 0, F.lit(0).cast("bigint")).otherwise(F.col("k") + 2)
    moves = rows.select((F.col("k") + 1).alias("src"), to.alias("dst"), F.array(F.when(F.col("free"), 0).otherwise(-1)).alias("upd"))
    positions = rows.select((F.col("k") + 1).alias("pos"), F.lit(True).alias("is_attack")).unionByName(spark.createDataFrame([(0, False)], "pos bigint, is_attack boolean"))
    return from_tables(positions, moves.join(positions.select(F.col("pos").alias("dst")), "dst", "left_semi").select("src", "dst", "upd"), ONE_DIMENSION)
