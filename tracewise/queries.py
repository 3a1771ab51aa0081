"""Driver queries over the warehouse tables, whole, and SQL that gives the same rows by definition rather than by the game."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions import energy as E
from tracewise.operators import build, refine, solve
from tracewise.plans.equivalence import LTS, Equivalence
from tracewise.plans.iterate import cut, shared_dir
from tracewise.plans.relation import Relation
from tracewise.sources import games, lts

#: Solved systems by table folder, for the queries that read different things from one solution. ``forget`` empties it.
_SOLVED: dict[tuple, Equivalence] = {}


def forget() -> None:
    _SOLVED.clear()


def _system(spark: SparkSession, sf_dir: str, name: str) -> LTS:
    edges = {"conv": lts.conversation_edges, "evt": lts.event_edges, "cust": lts.customer_edges, "nat": lts.nation_edges, "parcel": lts.parcel_edges}[name](spark, sf_dir)
    return LTS(edges, sparse=True)


def _solved(spark: SparkSession, sf_dir: str, name: str) -> Equivalence:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SOLVED:
        system = _system(spark, sf_dir, name)
        _SOLVED[key] = LTS(cut(system.edges), sparse=True).equivalences()
    return _SOLVED[key]


def _text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


def edges_of(name: str):
    return lambda spark, sf_dir: _system(spark, sf_dir, name).edges


def states_of(name: str):
    return lambda spark, sf_dir: _system(spark, sf_dir, name).states


def out_degree(spark, sf_dir):
    s = _system(spark, sf_dir, "cust")
    return s.states.join(s.edges.groupBy(F.col("src").alias("pid")).count(), "pid", "left").select("pid", F.coalesce("count", F.lit(0)).alias("moves"))


def deadlocks(spark, sf_dir):
    s = _system(spark, sf_dir, "cust")
    return s.states.join(s.edges.select(F.col("src").alias("pid")), "pid", "left_anti")


def _conv_lines(spark, sf_dir):
    e = _system(spark, sf_dir, "conv").edges
    return e.select(F.col("src").alias("line"), F.concat_ws(",", "src", "dst", F.concat(F.lit('"'), F.col("label"), F.lit('"'))).alias("value"))


def text_edges(spark, sf_dir):
    """Turns written as lines and read by the text source."""
    return lts.from_lines(_conv_lines(spark, sf_dir), lts.LARGEST)[0]


def label_dictionary(spark, sf_dir):
    return lts.from_lines(_conv_lines(spark, sf_dir), lts.LARGEST)[1]


def enabled_sets(spark, sf_dir):
    s = _system(spark, sf_dir, "cust")
    return refine.enabled_sets(s.edges, s.states).select("pid", _text("enabled").alias("enabled"))


def enabledness_partitions(spark, sf_dir):
    s = _system(spark, sf_dir, "evt")
    return refine.enabledness_partitions(s.edges, s.states).select("pid", _text("enabled").alias("enabled"), "class_id")


def enabledness_partitions_subset(spark, sf_dir):
    s = _system(spark, sf_dir, "evt")
    clicks = s.states.where("pid div 256 % 256 = ascii('c')")
    return refine.enabledness_partitions(s.edges, s.states, clicks).select("pid", _text("enabled").alias("enabled"), "class_id")


def enabledness_compare(spark, sf_dir):
    """The labels of both ends of every edge."""
    s = _system(spark, sf_dir, "evt")
    sets = refine.enabled_sets(s.edges, s.states)
    pairs = s.edges.select(F.col("src").alias("p"), F.col("dst").alias("q")).distinct()
    pairs = pairs.join(sets.select(F.col("pid").alias("p"), F.col("enabled").alias("ep")), "p").join(sets.select(F.col("pid").alias("q"), F.col("enabled").alias("eq")), "q")
    le, ge = refine.compare_enabled("ep", "eq")
    return pairs.select("p", "q", le.alias("q_within_p"), ge.alias("q_contains_p"))


def set_transition(spark, sf_dir):
    """Where the nations of a region lead together, by label."""
    s = _system(spark, sf_dir, "nat")
    sets = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.col("n_regionkey").cast("bigint").alias("key")).agg(F.collect_set(F.col("n_nationkey").cast("bigint")).alias("q"))
    return refine.post_image(sets, s.edges).select("key", "label", _text("image").alias("image"))


def signature_round1(spark, sf_dir):
    s = LTS(cut(_system(spark, sf_dir, "cust").edges), sparse=True)
    one = s.states.select("pid", F.lit(0).cast("bigint").alias("cls"))
    sig = refine.signatures(s.edges, s.states, one)
    return sig.select("pid", F.array_join(F.transform("signature", lambda x: x["label"]), ",").alias("signature"))


def _refined(spark, sf_dir, name: str):
    s = _system(spark, sf_dir, name)
    edges = cut(s.edges)
    return refine.refine(edges)


def bisim_classes(name: str):
    def query(spark, sf_dir):
        return _refined(spark, sf_dir, name)

    return query


def bisim_class_count(spark, sf_dir):
    return _refined(spark, sf_dir, "cust").agg(F.countDistinct("cls").alias("classes"))


def class_numbers(spark, sf_dir):
    return refine.numbered(_refined(spark, sf_dir, "parcel"))


def quotient_edges(name: str):
    def query(spark, sf_dir):
        s = _system(spark, sf_dir, name)
        edges = cut(s.edges)
        return refine.quotient(edges, refine.refine(edges)).groupBy("src", "label", "dst").agg(F.count("*").alias("n"))

    return query


def start_pairs(spark, sf_dir):
    s = _system(spark, sf_dir, "nat")
    return build.start_pairs(s.edges, s.states)


def start_pairs_subset(spark, sf_dir):
    s = _system(spark, sf_dir, "nat")
    return build.start_pairs(s.edges, s.states, s.states.where("pid < 1000"))


def _seeds(spark, sf_dir):
    s = _system(spark, sf_dir, "nat")
    edges = cut(s.edges)
    s = LTS(edges, sparse=True)
    return s, _spelled(cut(build.seeds(build.start_pairs(s.edges, s.states))))


def _spelled(positions):
    """Positions called by what they are instead of by number, so that their moves are too."""
    return positions.withColumn("pos", build.spelled())


def attack_moves(spark, sf_dir):
    s, at = _seeds(spark, sf_dir)
    return build.attack_moves(at, s.edges).select("src", F.col("upd").cast("bigint").alias("upd"), build.spelled("to").alias("dst"))


def defend_moves(spark, sf_dir):
    """From the plain conjunctions of the seeds."""
    _, at = _seeds(spark, sf_dir)
    d = at.select(build.defend(F.col("p"), F.col("q"), F.array().cast("array<bigint>")).alias("d")).select("d.*")
    d = _spelled(d)
    return build.defend_moves(d).select("src", F.col("upd").cast("bigint").alias("upd"), build.spelled("to").alias("dst"))


def clause_moves(spark, sf_dir):
    _, at = _seeds(spark, sf_dir)
    c = at.select(build.clause(F.col("p"), F.col("q")[0]).alias("c")).select("c.*")
    c = _spelled(c)
    return build.clause_moves(c).select("src", F.col("upd").cast("bigint").alias("upd"), build.spelled("to").alias("dst"))


def _parcel_sets(spark, sf_dir):
    """Attack positions that compare the first parcel of each order with all its others, where these are two or more, called by the order, of
    which each has one; ``key`` tells them in full."""
    edges = cut(_system(spark, sf_dir, "parcel").edges)
    open_ = edges.where("label = 'open'").groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("all")).where("size(all) > 2")
    at = open_.select(F.col("src").alias("pos"), build.attack(F.col("all")[0], F.slice("all", 2, F.size("all") - 1)).alias("a"))
    return edges, at.select("pos", "a.kind", "a.p", "a.q", "a.qx", build.spelled("a").alias("key"))


def split_moves(spark, sf_dir):
    """Observations and conjunctions from sets of several states, with all splits."""
    edges, at = _parcel_sets(spark, sf_dir)
    moves = build.attack_moves(at, edges, beside=("key",), apart=False)
    return moves.select(F.col("key").alias("src"), F.col("upd").cast("bigint").alias("upd"), build.spelled("to").alias("dst"))


def revival_moves(spark, sf_dir):
    """Answers and revivals from the conjunctions of ``split_moves``."""
    edges, at = _parcel_sets(spark, sf_dir)
    made = build.attack_moves(at, edges, apart=False).where("to.kind = 'D'").select("to.*")
    made = _spelled(made)
    return build.defend_moves(made).select("src", F.col("upd").cast("bigint").alias("upd"), build.spelled("to").alias("dst"))


def game_size(name: str):
    def query(spark, sf_dir):
        game = _solved(spark, sf_dir, name).game
        kinds = game.positions.groupBy(F.concat(F.lit("positions "), "kind").alias("what")).agg(F.count("*").alias("n"))
        moves = game.moves.groupBy(F.concat(F.lit("moves "), F.col("upd").cast("string")).alias("what")).agg(F.count("*").alias("n"))
        return kinds.unionByName(moves)

    return query


def attack_alone(spark, sf_dir):
    """The moves of one position and those into it, by position."""
    game = _solved(spark, sf_dir, "conv").game
    first = game.positions.where("kind = 'A' AND size(q) = 1").agg(F.min(F.struct("p", F.col("q")[0].alias("q"))).alias("m")).select("m.*")
    pos = build.attack(F.col("p"), F.array("q"), game.seed)["pos"].alias("pos")
    out = game.moves.join(first.select(pos), F.col("src") == F.col("pos"), "left_semi").select(F.lit("out").alias("way"), F.col("upd").cast("bigint").alias("upd"))
    return out.unionByName(game.moves.join(first.select(pos), F.col("dst") == F.col("pos"), "left_semi").select(F.lit("in").alias("way"), F.col("upd").cast("bigint").alias("upd")))


def _vectors(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    parts = [s % 4, F.floor(s / 4) % 4, k % 4, F.floor(k / 4) % 4, F.floor(k / 16) % 4, F.floor(k / 64) % 4]
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pid"), "p_brand", F.array(*[p.cast("bigint") for p in parts]).alias("e"))


def _vector_pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("pid", "e")
    return v.join(v.select((F.col("pid") - 1).alias("pid"), F.col("e").alias("f")), "pid")


def energy_pack(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("pid", F.get(E.packed_words(F.col("e"), E.STANDARD), F.lit(0)).alias("word"), E.show_energy(F.col("e")).alias("shown"))


def energy_order(spark, sf_dir):
    return _vector_pairs(spark, sf_dir).select("pid", E.compare_order(F.col("e"), F.col("f")).cast("bigint").alias("ord"))


def inverse_update(spark, sf_dir):
    code = E.codec(E.STANDARD)
    x = E.inverse_update(code, code.from_array(F.col("e")), [-1, 0, 1, 5, 0, -1])
    return _vectors(spark, sf_dir).select("pid", _text_of(code.to_array(x)).alias("e"))


def supremum(spark, sf_dir):
    code = E.codec(E.STANDARD)
    x = code.sup(code.from_array(F.col("e")), code.from_array(F.col("f")))
    return _vector_pairs(spark, sf_dir).select("pid", _text_of(code.to_array(x)).alias("e"))


def _text_of(array):
    return F.array_join(array.cast("array<string>"), ",")


def notion_test(spark, sf_dir):
    code = E.codec(E.STANDARD)
    v = _vectors(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(n).alias("notion"), E.holds(code, F.array(code.from_array(F.col("e"))), x).alias("holds")) for n, x in E.NOTIONS.items()])
    return v.select("pid", F.explode(each).alias("v")).groupBy("v.notion").agg(F.sum(F.col("v.holds").cast("bigint")).alias("held"))


def skyline(spark, sf_dir):
    """The minimal vectors of the parts of each brand."""
    code = E.codec(E.STANDARD)
    sets = _vectors(spark, sf_dir).groupBy("p_brand").agg(F.collect_set(code.from_array(F.col("e"))).alias("es"))
    return sets.select("p_brand", F.explode(E.skyline(code, F.col("es"))).alias("x")).select("p_brand", _text_of(code.to_array(F.col("x"))).alias("e"))


def _energies(solved: DataFrame) -> DataFrame:
    return solved.select("pos", F.explode("energies").alias("e")).select("pos", _text("e").alias("e"))


def solve_game(game):
    return lambda spark, sf_dir: _energies(solve.solve(game(spark, sf_dir)))


def reach_targets(spark, sf_dir):
    """Positions of the orders' game that are won from the start: items, and customers without orders."""
    return solve.standard_reach(games.order_game(spark, sf_dir)).select("pos")


def reverse_moves(spark, sf_dir):
    """The moves into the order of the least key."""
    least = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min("o_orderkey").cast("bigint").alias("k")).first().k
    return games.order_game(spark, sf_dir).reverse(least * 4 + 2).select("src", "dst")


#: Two machines: after a coin, 0 offers tea or coffee, one of them; 10 offers one of them, or both.
MACHINES = [(0, 1, 0), (0, 2, 0), (1, 3, 1), (2, 3, 2), (10, 1, 0), (10, 2, 0), (10, 11, 0), (11, 3, 1), (11, 3, 2)]


def compare_pairs(order: str):
    """Pairs of parcels of one order, one way round, compared in one game; most have different enabled labels."""

    def query(spark, sf_dir):
        s = LTS(cut(lts.parcel_edges(spark, sf_dir)), sparse=True)
        opened = s.edges.where("label = 'open'")
        pairs = opened.select("src", F.col("dst").alias("p")).join(opened.select("src", F.col("dst").alias("q")), "src").where(order)
        return s.verdicts_of(pairs)

    return query


def universe_nat(spark, sf_dir):
    return LTS(lts.nation_edges(spark, sf_dir)).states


def adjacency_nat(spark, sf_dir):
    s = LTS(lts.nation_edges(spark, sf_dir))
    return s.adj(1).withColumn("states", F.lit(s.n_vertices()).cast("bigint"))


def text_files(spark, sf_dir):
    """Turns written to several text files and read back."""
    path = f"{shared_dir(spark)}/lines-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    _conv_lines(spark, sf_dir).repartitionByRange(3, "line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)
    return lts.from_text(spark, path, lts.LARGEST)[0]


def json_round_trip(spark, sf_dir):
    """The nation system, its labels numbered in order, written as a JSON document in pieces and read back."""
    path = f"{shared_dir(spark)}/json-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    edges = lts.nation_edges(spark, sf_dir)
    names = F.broadcast(lts.ranked(edges.select("label").distinct(), "label", "number"))  # market segments and one more
    s = LTS(edges.join(names, "label").select("src", "dst", F.col("number").cast("int").alias("label")))
    lts.write_json(s.edges, path)
    return lts.from_json(spark, path)


def game_json(spark, sf_dir):
    """The suppliers' diamonds written as a JSON document in pieces, read back and solved."""
    path = f"{shared_dir(spark)}/game-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    games.write_json(games.supplier_game(spark, sf_dir), path)
    return _energies(solve.solve(games.from_json(spark, path)))


def solve_reach(spark, sf_dir):
    """The orders' game won at finished orders instead of at items."""
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select((F.col("o_orderkey").cast("bigint") * 4 + 2).alias("pos"))
    return _energies(solve.solve(games.order_game(spark, sf_dir), done))


def wide_algebra(spark, sf_dir):
    """Supremum and inverse update in a configuration too wide for one number."""
    conf = E.EnergyConf(6, (1 << 32) - 1)
    code = E.codec(conf)
    x = E.inverse_update(code, code.sup(F.col("e"), F.col("f")), [-1, 0, 1, 5, 0, -1])
    return _vector_pairs(spark, sf_dir).select("pid", _text_of(code.to_array(x)).alias("e"))


def word_round_trip(spark, sf_dir):
    """Energies and updates in the compact external form and back."""
    u = F.transform("e", lambda x: F.when(x == 3, -1).otherwise(x).cast("int"))
    words = E.packed_update(u, E.STANDARD)
    return _vectors(spark, sf_dir).select(
        "pid",
        _text_of(E.unpacked_words(E.packed_words(F.col("e"), E.STANDARD), E.STANDARD)).alias("energy"),
        F.get(words, F.lit(0)).alias("word"),
        _text_of(E.unpacked_update(words, E.STANDARD)).alias("upd"),
        E.show_update(u).alias("shown"),
    )


def energy_sets(spark, sf_dir):
    """Sets of two energies: size, members, replacement, equality in any order, text."""
    es = F.array("e", "f")
    swapped = E.set_energy(E.set_energy(es, 0, E.get_energy(es, 1), E.STANDARD), 1, E.get_energy(es, 0), E.STANDARD)
    return _vector_pairs(spark, sf_dir).select("pid", E.n_energies(es).alias("n"), _text_of(E.get_energy(swapped, 0)).alias("first"), E.same_energies(es, swapped).alias("same"), E.show_energies(es).alias("shown"))


def preorders(name: str, notion: str):
    """Ordered pairs of different classes of bisimilar states."""
    return lambda spark, sf_dir: _solved(spark, sf_dir, name).preorders(notion)


def preorders_whole(name: str, notion: str):
    """Ordered pairs of different classes of bisimilar states, also of different enabled labels."""
    return lambda spark, sf_dir: _solved(spark, sf_dir, name).below(notion)


def equivalents(name: str, notion: str):
    return lambda spark, sf_dir: _solved(spark, sf_dir, name).equivalents(notion)


def class_of(name: str, notion: str):
    """The class of the least state."""

    def query(spark, sf_dir):
        s = _solved(spark, sf_dir, name)
        return s.class_of(s.part.agg(F.min("pid").alias("m")).first().m, notion)

    return query


def relation_union(spark, sf_dir):
    """Failure equivalence of parcels, with the classes of an order's parcels of tax 0 and 1 merged."""
    rel = Relation(cut(_solved(spark, sf_dir, "parcel").relation("failures")))
    links = rel.classes.select(F.col("pid").alias("p"), (F.col("pid") + 1).alias("q")).where("p % 64 = 1")
    return rel.union(links).classes


def unminimized_nat(spark, sf_dir):
    """Similarity of nations, of the subset of nations alone, without a quotient."""
    s = LTS(cut(lts.nation_edges(spark, sf_dir)), sparse=True)
    return s.equivalences_unminimized(s.states.where("pid < 1000")).preorders("simulation")


def bound_energies(spark, sf_dir):
    """Solved pairs taken as given results and bound to their pairs and quotient again."""
    s = _solved(spark, sf_dir, "parcel")
    return type(s).bind(s.pairs.select("p", "q"), s.pairs).set_minimization(s.part).relation("revivals")


def relation(name: str, notion: str):
    return lambda spark, sf_dir: _solved(spark, sf_dir, name).relation(notion)


def preorder(name: str, notion: str):
    """Ordered pairs of different states with equal enabled labels, all of them, also bisimilar ones."""

    def query(spark, sf_dir):
        s = _solved(spark, sf_dir, name)
        below = s.preorders(notion).unionByName(s.part.select(F.col("cls").alias("p"), F.col("cls").alias("q")).distinct())
        left, right = s.part.select(F.col("cls").alias("p"), F.col("pid").alias("a")), s.part.select(F.col("cls").alias("q"), F.col("pid").alias("b"))
        return below.join(left, "p").join(right, "q").where("a <> b").select(F.col("a").alias("p"), F.col("b").alias("q"))

    return query


def classes(name: str, notion: str):
    return lambda spark, sf_dir: _solved(spark, sf_dir, name).classes(notion)


def report(name: str, only: list[str] | None = None):
    def query(spark, sf_dir):
        out = _solved(spark, sf_dir, name).report()
        return out.where(F.col("notion").isin(only)) if only else out

    return query


COUNTED = ["enabledness", "traces", "simulation", "bisimulation"]

QUERIES = {
    "lts_edges_conv": edges_of("conv"),
    "lts_edges_evt": edges_of("evt"),
    "lts_edges_cust": edges_of("cust"),
    "lts_edges_nat": edges_of("nat"),
    "lts_edges_parcel": edges_of("parcel"),
    "universe_nat": universe_nat,
    "adjacency_nat": adjacency_nat,
    "text_files": text_files,
    "json_round_trip": json_round_trip,
    "lts_states_conv": states_of("conv"),
    "out_degree": out_degree,
    "deadlocks": deadlocks,
    "text_edges": text_edges,
    "label_dictionary": label_dictionary,
    "enabled_sets": enabled_sets,
    "enabledness_partitions": enabledness_partitions,
    "enabledness_partitions_subset": enabledness_partitions_subset,
    "enabledness_compare": enabledness_compare,
    "set_transition": set_transition,
    "signature_round1": signature_round1,
    "bisim_classes_conv": bisim_classes("conv"),
    "bisim_classes_cust": bisim_classes("cust"),
    "bisim_classes_evt": bisim_classes("evt"),
    "bisim_classes_parcel": bisim_classes("parcel"),
    "class_numbers": class_numbers,
    "bisim_class_count": bisim_class_count,
    "quotient_edges_conv": quotient_edges("conv"),
    "quotient_edges_parcel": quotient_edges("parcel"),
    "start_pairs": start_pairs,
    "start_pairs_subset": start_pairs_subset,
    "attack_moves": attack_moves,
    "defend_moves": defend_moves,
    "clause_moves": clause_moves,
    "split_moves": split_moves,
    "revival_moves": revival_moves,
    "game_size_conv": game_size("conv"),
    "game_size_parcel": game_size("parcel"),
    "attack_alone": attack_alone,
    "energy_pack": energy_pack,
    "energy_order": energy_order,
    "inverse_update": inverse_update,
    "supremum": supremum,
    "notion_test": notion_test,
    "skyline": skyline,
    "wide_algebra": wide_algebra,
    "word_round_trip": word_round_trip,
    "energy_sets": energy_sets,
    "solve_diamond": solve_game(games.part_game),
    "solve_ladder": solve_game(games.ladder_game),
    "solve_orders": solve_game(games.order_game),
    "solve_least_cost": solve_game(games.least_cost_game),
    "reach_targets": reach_targets,
    "reverse_moves": reverse_moves,
    "solve_reach": solve_reach,
    "game_json": game_json,
    "compare_pair": compare_pairs("p < q"),
    "compare_pair_back": compare_pairs("p > q"),
    "relation_traces_conv": relation("conv", "traces"),
    "classes_bisimulation_conv": classes("conv", "bisimulation"),
    "report_conv": report("conv"),
    "preorder_simulation_nat": preorder("nat", "simulation"),
    "preorder_traces_nat": preorder("nat", "traces"),
    "relation_enabledness_nat": relation("nat", "enabledness"),
    "relation_simulation_nat": relation("nat", "simulation"),
    "relation_bisimulation_nat": relation("nat", "bisimulation"),
    "report_nat": report("nat", COUNTED),
    "report_evt": report("evt"),
    "relation_traces_evt": relation("evt", "traces"),
    "preorders_simulation_evt": preorders("evt", "simulation"),
    "spectrum_report": report("parcel"),
    "spectrum_report_nat": report("nat"),
    "relation_traces_parcel": relation("parcel", "traces"),
    "relation_simulation_parcel": relation("parcel", "simulation"),
    "relation_failures_parcel": relation("parcel", "failures"),
    "relation_revivals_parcel": relation("parcel", "revivals"),
    "relation_readiness_parcel": relation("parcel", "readiness"),
    "classes_failure_traces_parcel": classes("parcel", "failure_traces"),
    "preorders_simulation_parcel": preorders_whole("parcel", "simulation"),
    "preorders_failures_parcel": preorders("parcel", "failures"),
    "equivalents_traces_parcel": equivalents("parcel", "traces"),
    "class_of_parcel": class_of("parcel", "impossible_futures"),
    "relation_union": relation_union,
    "unminimized_nat": unminimized_nat,
    "bound_energies": bound_energies,
}

# SQL

_CONV = "conv AS (SELECT conv_id * 1048576 + turn AS src, conv_id * 1048576 + turn + 1 AS dst, role AS label FROM conversations)"
_EVT = "ev AS (SELECT user_id, user_id * 65536 + ascii(event_type) * 256 + ascii(substr(event_type, 2, 1)) AS src, event_type, ts, event_id FROM events), evt AS (SELECT DISTINCT src, dst, label FROM (SELECT src, lead(src) OVER w AS dst, lead(event_type) OVER w AS label FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dst IS NOT NULL)"
_CUST = "cust AS (SELECT o_custkey * 4 + 1 AS src, o_orderkey * 4 + 2 AS dst, o_orderpriority AS label FROM orders UNION ALL SELECT DISTINCT l_orderkey * 4 + 2, CAST(0 AS BIGINT), l_returnflag || '|' || l_linestatus FROM lineitem)"
_NAT = """bandmoves AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS src, CAST(floor(c_acctbal / 1000) AS BIGINT) + 2000 AS dst, c_mktsegment AS label FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL),
bands AS (SELECT DISTINCT dst AS band FROM bandmoves),
nat AS (SELECT src, dst, label FROM bandmoves UNION ALL SELECT a.band, b.band, 'up' FROM bands a JOIN bands b ON b.band = a.band + 1),
steps AS (SELECT band, max(band) OVER (PARTITION BY band - r) - band AS n FROM (SELECT band, row_number() OVER (ORDER BY band) AS r FROM bands)),
nstates AS (SELECT src AS pid FROM nat UNION SELECT dst FROM nat),
nsets AS (SELECT pid, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS enabled FROM nstates LEFT JOIN nat ON src = pid GROUP BY pid),
best AS (SELECT src AS pid, label, max(n) AS n FROM bandmoves JOIN steps ON dst = band GROUP BY ALL UNION ALL SELECT band, 'up', n - 1 FROM steps WHERE n > 0),
below AS (SELECT a.pid AS p, b.pid AS q FROM nsets a JOIN nsets b ON a.enabled = b.enabled AND a.pid <> b.pid WHERE NOT EXISTS (SELECT 1 FROM best x JOIN best y ON x.label = y.label WHERE x.pid = a.pid AND y.pid = b.pid AND x.n > y.n)),
simkey AS (SELECT pid, enabled || ':' || coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY label), '') AS k FROM nsets LEFT JOIN best USING (pid) GROUP BY pid, enabled),
bikey AS (SELECT pid, CASE WHEN pid >= 1000 THEN CAST((SELECT n FROM steps WHERE band = pid) AS VARCHAR) ELSE (SELECT string_agg(DISTINCT label || CAST(n AS VARCHAR), ',' ORDER BY label || CAST(n AS VARCHAR)) FROM bandmoves JOIN steps ON dst = band WHERE src = pid) END AS k FROM nstates)"""
_SUFFIX = _CONV + ", cstates AS (SELECT src AS pid FROM conv UNION SELECT dst FROM conv), suffix AS (SELECT pid, coalesce((SELECT string_agg(c.label, ',' ORDER BY c.src) FROM conv c WHERE c.src // 1048576 = pid // 1048576 AND c.src >= pid), '') AS s FROM cstates), cnamed AS (SELECT pid, min(pid) OVER (PARTITION BY s) AS cls FROM suffix)"
_BISIM_CUST = _CUST + """, kstates AS (SELECT src AS pid FROM cust UNION SELECT dst FROM cust),
items AS (SELECT pid, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS s FROM kstates LEFT JOIN cust ON src = pid WHERE pid % 4 <> 1 GROUP BY pid),
oclass AS (SELECT pid, min(pid) OVER (PARTITION BY s) AS cls FROM items),
placed AS (SELECT k.pid, string_agg(DISTINCT label || '>' || CAST(cls AS VARCHAR), ',' ORDER BY label || '>' || CAST(cls AS VARCHAR)) AS s FROM kstates k JOIN cust ON src = k.pid JOIN oclass o ON o.pid = dst WHERE k.pid % 4 = 1 GROUP BY k.pid),
knamed AS (SELECT pid, cls FROM oclass UNION ALL SELECT pid, min(pid) OVER (PARTITION BY s) FROM placed)"""
#: Parcels by order; a parcel's flags as a bit mask; an order's family of such masks; what each notion tells of a family.
_PARCEL = """items AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) * 64 AS o, CAST(l_orderkey AS BIGINT) * 64 + 1 + CAST(round(l_tax * 100) AS BIGINT) AS n, l_returnflag AS f FROM lineitem WHERE l_orderkey IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL),
parcel AS (SELECT DISTINCT o AS src, n AS dst, 'open' AS label FROM items UNION ALL SELECT n, o, f FROM items)"""
_FAMILY = _PARCEL + """, psets AS (SELECT o, n, sum(CASE f WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END)::BIGINT AS m FROM items GROUP BY ALL),
ofam AS (SELECT o, list(DISTINCT m ORDER BY m) AS fam FROM psets GROUP BY o),
fams AS (SELECT DISTINCT fam FROM ofam), member AS (SELECT fam, unnest(fam) AS m FROM fams),
allk AS (SELECT fam, CAST(bit_or(m) AS VARCHAR) AS k FROM member GROUP BY fam),
most AS (SELECT fam, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS k FROM member a WHERE NOT EXISTS (SELECT 1 FROM member b WHERE b.fam = a.fam AND b.m <> a.m AND a.m & b.m = a.m) GROUP BY fam),
fewest AS (SELECT fam, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS k FROM member a WHERE NOT EXISTS (SELECT 1 FROM member b WHERE b.fam = a.fam AND b.m <> a.m AND a.m & b.m = b.m) GROUP BY fam),
each AS (SELECT fam, string_agg(f || ':' || m, ',' ORDER BY f, m) AS k FROM (SELECT a.fam, f, a.m FROM member a, (VALUES (1), (2), (4)) AS t(f) WHERE a.m & f > 0 AND NOT EXISTS (SELECT 1 FROM member b WHERE b.fam = a.fam AND b.m <> a.m AND b.m & f > 0 AND a.m & b.m = b.m)) GROUP BY fam),
famkey AS (SELECT fam, allk.k AS traces, most.k AS simulation, fewest.k || '/' || allk.k AS failures, each.k AS revivals, array_to_string(fam, ',') AS readiness FROM allk JOIN most USING (fam) JOIN fewest USING (fam) JOIN each USING (fam)),
pstate AS (SELECT o AS pid, o, CAST(0 AS BIGINT) AS m FROM ofam UNION ALL SELECT n, o, m FROM psets),
pkey AS (SELECT pid, m, fam, m || '/' || traces AS traces, m || '/' || simulation AS simulation, m || '/' || failures AS failures, m || '/' || revivals AS revivals, m || '/' || readiness AS readiness FROM pstate JOIN ofam USING (o) JOIN famkey USING (fam)),
prep AS (SELECT min(pid) AS cls, m, fam, any_value(traces) AS traces FROM pkey GROUP BY m, fam)"""
#: The column of famkey that tells each notion; readiness tells a whole family.
_TOLD = {"traces": "traces", "failures": "failures", "impossible_futures": "failures", "revivals": "revivals", "failure_traces": "revivals", "simulation": "simulation"}


def _parcel_named(key: str) -> str:
    return f"WITH {_FAMILY} SELECT pid, min(pid) OVER (PARTITION BY {key}) AS class_id FROM pkey"


def _parcel_below(unmatched: str, labels: str = "p.m = q.m") -> str:
    """Pairs of classes with the same labels, or with labels in the relation ``labels``, whose families are related: no member of the first is unmatched in the second."""
    return f"""WITH {_FAMILY}, bad AS (SELECT x.fam AS a, y.fam AS b FROM fams x, fams y WHERE {unmatched})
SELECT p.cls AS p, q.cls AS q FROM prep p JOIN prep q ON {labels} AND p.cls <> q.cls WHERE NOT EXISTS (SELECT 1 FROM bad WHERE a = p.fam AND b = q.fam)"""


#: More rounds of refinement than any size of the tables takes.
_ROUNDS = 12
_BISIM_EVT = _EVT + ", r0 AS (SELECT src AS pid, CAST(0 AS BIGINT) AS cls FROM evt UNION SELECT dst, 0 FROM evt)" + "".join(
    f", s{i} AS MATERIALIZED (SELECT r.pid, coalesce(string_agg(DISTINCT label || '>' || t.cls, ',' ORDER BY label || '>' || t.cls), '') AS s FROM r{i} r LEFT JOIN evt ON src = r.pid LEFT JOIN r{i} t ON t.pid = dst GROUP BY r.pid), r{i + 1} AS MATERIALIZED (SELECT pid, min(pid) OVER (PARTITION BY s) AS cls FROM s{i})"
    for i in range(_ROUNDS)
)
#: States of ``evt`` have at most one move of a label, so each notion but enabledness tells apart what bisimilarity does, and one state is below
#: another if it has no sequence of labels that the other hasn't: ``more`` are the pairs of classes where it has.
_EVT_MORE = "RECURSIVE " + _BISIM_EVT + f""", ec AS MATERIALIZED (SELECT a.cls AS src, label, b.cls AS dst FROM evt JOIN r{_ROUNDS} a ON a.pid = src AND a.cls = src JOIN r{_ROUNDS} b ON b.pid = dst),
els AS MATERIALIZED (SELECT cls, list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)) AS ls FROM (SELECT DISTINCT cls FROM r{_ROUNDS}) LEFT JOIN ec ON src = cls GROUP BY cls),
more(p, q) AS (SELECT a.cls, b.cls FROM els a JOIN els b ON NOT list_has_all(coalesce(b.ls, []), coalesce(a.ls, []))
UNION SELECT x.src, y.src FROM more JOIN ec x ON x.dst = p JOIN ec y ON y.dst = q AND y.label = x.label)"""
#: The game on the quotient of the conversations, whose states have one move at most: positions of a kind, a state and another or none.
_GAME_CONV = """RECURSIVE """ + _SUFFIX + """, q AS (SELECT DISTINCT a.cls AS p, label, b.cls AS nxt FROM conv JOIN cnamed a ON a.pid = src JOIN cnamed b ON b.pid = dst),
qs AS (SELECT DISTINCT cls AS p, coalesce(label, '') AS label FROM cnamed LEFT JOIN (SELECT p AS cls, label FROM q) USING (cls)),
pos(kind, p, x) AS (SELECT 'A', a.p, b.p FROM qs a JOIN qs b ON a.label = b.label AND a.p <> b.p
UNION SELECT m.kind, m.p, m.x FROM (
  SELECT 'A' AS kind, n.nxt AS p, CASE WHEN o.label = n.label THEN o.nxt ELSE -1 END AS x FROM pos JOIN q n ON n.p = pos.p LEFT JOIN q o ON o.p = pos.x WHERE pos.kind = 'A' AND pos.x >= 0 AND NOT (coalesce(o.label = n.label, false) AND o.nxt = n.nxt)
  UNION ALL SELECT 'D', p, x FROM pos WHERE kind = 'A'
  UNION ALL SELECT 'C', p, x FROM pos WHERE kind = 'D' AND x >= 0
  UNION ALL SELECT 'A', p, x FROM pos WHERE kind = 'C' AND p <> x
  UNION ALL SELECT 'A', x, p FROM pos WHERE kind = 'C' AND p <> x) m)"""
#: The game on the quotient of the parcels, round by round from its definition: positions are pairs of a class and a set of classes. ``em`` is the
#: mask of a class's labels (8: open), ``qe`` its moves with their numbers, ``tl`` its targets by label; ``part`` the four ways to split a set.
_GAME_PARCEL = "RECURSIVE " + _FAMILY + """, c AS (SELECT pid, m, min(pid) OVER (PARTITION BY readiness) AS cls FROM pkey),
qe AS MATERIALIZED (SELECT a.cls AS src, label, b.cls AS dst, count(*) AS n FROM parcel JOIN c a ON a.pid = src JOIN c b ON b.pid = dst WHERE a.pid = a.cls GROUP BY ALL),
tl AS MATERIALIZED (SELECT src, label, list(dst) AS ts FROM qe GROUP BY ALL),
qm AS MATERIALIZED (SELECT DISTINCT cls, CASE m WHEN 0 THEN 8 ELSE m END AS em FROM c),
att(p, q) AS (SELECT a.cls, [b.cls] FROM qm a JOIN qm b ON a.em = b.em AND a.cls <> b.cls
UNION SELECT p, q FROM (
  WITH img AS (SELECT p, q, label, list_sort(list_distinct(flatten(list(ts)))) AS q2 FROM (SELECT p, q, unnest(q) AS x FROM att) JOIN tl ON src = x GROUP BY ALL),
  part AS (SELECT p, q, list(x ORDER BY x) FILTER (WHERE b.em & a.em = b.em) AS le, list(x ORDER BY x) FILTER (WHERE b.em & a.em = a.em) AS ge, list(x ORDER BY x) FILTER (WHERE b.em = a.em) AS eq
    FROM (SELECT p, q, unnest(q) AS x FROM att) JOIN qm a ON a.cls = p JOIN qm b ON b.cls = x GROUP BY ALL)
  SELECT e.dst AS p, coalesce(q2, []) AS q FROM att JOIN qe e ON e.src = att.p LEFT JOIN img ON img.p = att.p AND img.q = att.q AND img.label = e.label WHERE len(att.q) > 0 AND NOT coalesce(list_contains(q2, e.dst), false)
  UNION ALL SELECT p, [unnest(q)] FROM att
  UNION ALL SELECT unnest(q), [p] FROM att
  UNION ALL SELECT p, qx FROM (SELECT p, q, unnest([le, ge, eq]) AS qx FROM part) WHERE len(qx) < len(q)) m),
img AS (SELECT p, q, label, list_sort(list_distinct(flatten(list(ts)))) AS q2 FROM (SELECT p, q, unnest(q) AS x FROM att) JOIN tl ON src = x GROUP BY ALL),
seen AS (SELECT sum(e.n) AS n FROM att JOIN qe e ON e.src = att.p LEFT JOIN img ON img.p = att.p AND img.q = att.q AND img.label = e.label WHERE len(att.q) > 0 AND NOT coalesce(list_contains(q2, e.dst), false)),
conj AS (SELECT DISTINCT p, q, v, coalesce(qx, []) AS qx FROM (SELECT p, q, 0 AS v, NULL::BIGINT[] AS qx FROM att
  UNION ALL SELECT p, q, 1, unnest([list(x ORDER BY x) FILTER (WHERE b.em & a.em = b.em), list(x ORDER BY x) FILTER (WHERE b.em & a.em = a.em), list(x ORDER BY x) FILTER (WHERE b.em = a.em)])
    FROM (SELECT p, q, unnest(q) AS x FROM att) JOIN qm a ON a.cls = p JOIN qm b ON b.cls = x GROUP BY p, q) WHERE v = 0 OR len(qx) BETWEEN 1 AND len(q) - 1),
asked AS (SELECT count(*) AS n FROM (SELECT DISTINCT p, unnest(q) AS x FROM att)),
sizes AS (SELECT 'positions A' AS what, count(*) AS n FROM att UNION ALL SELECT 'positions D', count(*) FROM conj UNION ALL SELECT 'positions C', n FROM asked
UNION ALL SELECT 'moves 0', n FROM seen UNION ALL SELECT 'moves 1', count(*) FROM conj UNION ALL SELECT 'moves 2', sum(len(q) - len(qx)) FROM conj
UNION ALL SELECT 'moves 3', count(*) FROM conj WHERE len(qx) > 0 UNION ALL SELECT 'moves 4', n FROM asked UNION ALL SELECT 'moves 5', n FROM asked)"""
_OBS_CONV = "(SELECT count(*) FROM pos JOIN q n ON n.p = pos.p LEFT JOIN q o ON o.p = pos.x WHERE pos.kind = 'A' AND pos.x >= 0 AND NOT (coalesce(o.label = n.label, false) AND o.nxt = n.nxt))"
_SPLITS = _PARCEL + """, ns AS (SELECT o, n, sum(CASE f WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END)::BIGINT AS m FROM items GROUP BY ALL),
first AS (SELECT o, min(n) AS p, arg_min(m, n) AS pm FROM ns GROUP BY o HAVING count(*) > 2),
other AS (SELECT first.o, p, pm, n AS x, m FROM first JOIN ns ON ns.o = first.o AND n <> p),
part AS (SELECT o, p, v, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (WHERE NOT c), '') AS q, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (WHERE c), '') AS qx
  FROM (SELECT *, CASE v WHEN 0 THEN false WHEN 1 THEN m & pm = m WHEN 2 THEN m & pm = pm ELSE m = pm END AS c FROM other, (VALUES (0), (1), (2), (3)) AS t(v)) GROUP BY ALL),
conj AS (SELECT DISTINCT o, p, q, qx FROM part WHERE v = 0 OR (q <> '' AND qx <> '')),
start AS (SELECT o, 'A:' || p || ':' || string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS src, p, pm, bit_or(m) AS qm FROM other GROUP BY o, p, pm)"""
_VEC = "vec AS (SELECT p_partkey AS pid, p_brand, p_size % 4 AS e1, (p_size // 4) % 4 AS e2, p_partkey % 4 AS e3, (p_partkey // 4) % 4 AS e4, (p_partkey // 16) % 4 AS e5, (p_partkey // 64) % 4 AS e6 FROM part)"
_ES = [f"e{i}" for i in range(1, 7)]
_LE = " AND ".join(f"a.{e} <= b.{e}" for e in _ES)
_GE = " AND ".join(f"a.{e} >= b.{e}" for e in _ES)
_UPD = "concat_ws(',', least(e1 + 1, 3), e2, e3, e4, e5, least(e6 + 1, 3))"


def _named(key: str) -> str:
    return f"WITH {_NAT} SELECT pid, min(pid) OVER (PARTITION BY k) AS class_id FROM {key}"


def _diamonds(rows: str) -> str:
    """The supremum of the first attacker's decrement and the second's two."""
    tops = ", ".join(f"greatest(CASE WHEN a = {i} THEN 1 ELSE 0 END, CASE WHEN b = {i} THEN 1 ELSE 0 END + CASE WHEN c = {i} THEN 1 ELSE 0 END)" for i in range(6))
    second = ", ".join(f"CASE WHEN c = {i} THEN 1 ELSE 0 END" for i in range(6))
    zero = "'0,0,0,0,0,0'"
    return f"WITH d AS ({rows}) SELECT pos, concat_ws(',', {tops}) AS e FROM d UNION ALL SELECT pos + 1, {zero} FROM d UNION ALL SELECT pos + 2, concat_ws(',', {second}) FROM d UNION ALL SELECT pos + 3, {zero} FROM d"


def _led(before: str, i: int) -> str:
    """The i-th minimum of an update on the bits of an energy of ones and zeros."""
    raised = ", ".join(f"CASE WHEN u{i} = {j + 1} THEN greatest(b{j}, b{i}) ELSE b{j} END AS b{j}" for j in range(6))
    return f"l{i} AS (SELECT pos, item, {', '.join(f'u{j}' for j in range(6))}, {raised} FROM {before})"


#: Orders, their items' updates, and what each item asks for as a bit mask; positions won from the start.
_ORDER_GAME = (
    "og AS (SELECT CAST(o_custkey AS BIGINT) * 4 + 1 AS cust, CAST(o_orderkey AS BIGINT) * 4 + 2 AS pos FROM orders), "
    "ud AS (SELECT CAST(l_orderkey AS BIGINT) * 4 + 2 AS pos, (CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 4 + 3 AS item, " + ", ".join(f"((CAST(l_orderkey AS BIGINT) * 31 + l_partkey) // {8**i}) % 8 - 1 AS u{i}" for i in range(6)) + " FROM lineitem), "
    "l AS (SELECT *, " + ", ".join(f"CASE WHEN u{i} = -1 THEN 1 ELSE 0 END AS b{i}" for i in range(6)) + " FROM ud), "
    + ", ".join(_led("l" if i == 0 else f"l{i - 1}", i) for i in range(6))
    + ", asked AS (SELECT DISTINCT pos, " + " + ".join(f"b{i} * {2**i}" for i in range(6)) + " AS m FROM l5), "
    "free AS (SELECT DISTINCT CAST(item AS BIGINT) AS pos FROM ud UNION ALL SELECT CAST(c_custkey AS BIGINT) * 4 + 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))"
)
#: The energies of ones and zeros with which an order or a customer is won.
_ORDER_WON = (
    "worder AS MATERIALIZED (SELECT DISTINCT pos, x FROM asked, range(64) t(x) WHERE x & m = m), "
    "wcust AS (SELECT cust AS pos, x FROM og JOIN worder USING (pos) JOIN (SELECT cust, count(*) AS n FROM og GROUP BY cust) USING (cust) GROUP BY cust, x, n HAVING count(*) = n), "
    "won AS MATERIALIZED (SELECT pos, x FROM worder UNION ALL SELECT pos, x FROM wcust)"
)


def _bits(x: str) -> str:
    return "concat_ws(',', " + ", ".join(f"({x} >> {i}) & 1" for i in range(6)) + ")"


def _compared(way: str) -> str:
    """Parcels of one order lead back to it, so their flags alone tell them: by inclusion where only what can be done counts."""
    return f"WITH {_FAMILY} SELECT a.n AS p, b.n AS q, notion, CASE WHEN notion IN ('enabledness', 'traces', 'simulation') THEN a.m & b.m = a.m ELSE a.m = b.m END AS holds FROM psets a JOIN psets b ON a.o = b.o AND a.n {way} b.n, (VALUES " + ", ".join(f"('{n}')" for n in E.NOTIONS) + ") AS t(notion)"


ORACLE_SQL = {
    "lts_edges_conv": f"WITH {_CONV} SELECT src, dst, label FROM conv",
    "lts_edges_evt": f"WITH {_EVT} SELECT src, dst, label FROM evt",
    "lts_edges_cust": f"WITH {_CUST} SELECT src, dst, label FROM cust",
    "lts_edges_nat": f"WITH {_NAT} SELECT src, dst, label FROM nat",
    "lts_states_conv": f"WITH {_CONV} SELECT src AS pid FROM conv UNION SELECT dst FROM conv",
    "out_degree": f"WITH {_CUST}, s AS (SELECT src AS pid FROM cust UNION SELECT dst FROM cust) SELECT pid, count(src) AS moves FROM s LEFT JOIN cust ON src = pid GROUP BY pid",
    "deadlocks": f"WITH {_CUST} SELECT DISTINCT dst AS pid FROM cust WHERE dst NOT IN (SELECT src FROM cust)",
    "text_edges": f"WITH {_CONV}, f AS (SELECT label AS name, min(src) AS line FROM conv GROUP BY 1), d AS (SELECT name, row_number() OVER (ORDER BY line) AS n FROM f WHERE name <> 'i' UNION ALL SELECT 'i', 0) SELECT src, dst, CAST(n AS INTEGER) AS label FROM conv JOIN d ON name = label",
    "label_dictionary": f"WITH {_CONV}, f AS (SELECT label AS name, min(src) AS line FROM conv GROUP BY 1) SELECT name, CAST(row_number() OVER (ORDER BY line) AS INTEGER) AS label FROM f WHERE name <> 'i' UNION ALL SELECT 'i', 0",
    "enabled_sets": f"WITH {_CUST}, s AS (SELECT src AS pid FROM cust UNION SELECT dst FROM cust) SELECT pid, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS enabled FROM s LEFT JOIN cust ON src = pid GROUP BY pid",
    "enabledness_partitions": f"WITH {_EVT}, s AS (SELECT src AS pid FROM evt UNION SELECT dst FROM evt), i AS (SELECT pid, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS enabled FROM s LEFT JOIN evt ON src = pid GROUP BY pid) SELECT pid, enabled, min(pid) OVER (PARTITION BY enabled) AS class_id FROM i",
    "enabledness_partitions_subset": f"WITH {_EVT}, s AS (SELECT src AS pid FROM evt UNION SELECT dst FROM evt), i AS (SELECT pid, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS enabled FROM s LEFT JOIN evt ON src = pid WHERE (pid // 256) % 256 = ascii('c') GROUP BY pid) SELECT pid, enabled, min(pid) OVER (PARTITION BY enabled) AS class_id FROM i",
    "enabledness_compare": f"WITH {_EVT}, i AS (SELECT pid, list(DISTINCT label) FILTER (WHERE label IS NOT NULL) AS ls FROM (SELECT src AS pid FROM evt UNION SELECT dst FROM evt) LEFT JOIN evt ON src = pid GROUP BY pid), e AS (SELECT DISTINCT src, dst FROM evt) SELECT src AS p, dst AS q, list_has_all(coalesce(a.ls, []), coalesce(b.ls, [])) AS q_within_p, list_has_all(coalesce(b.ls, []), coalesce(a.ls, [])) AS q_contains_p FROM e JOIN i a ON a.pid = src JOIN i b ON b.pid = dst",
    "set_transition": f"WITH {_NAT}, r AS (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS key, label, dst FROM nation JOIN nat ON src = n_nationkey) SELECT key, label, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS image FROM r GROUP BY key, label",
    "signature_round1": f"WITH {_CUST}, s AS (SELECT src AS pid FROM cust UNION SELECT dst FROM cust) SELECT pid, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS signature FROM s LEFT JOIN cust ON src = pid GROUP BY pid",
    "bisim_classes_conv": f"WITH {_SUFFIX} SELECT pid, cls FROM cnamed",
    "bisim_classes_cust": f"WITH {_BISIM_CUST} SELECT pid, cls FROM knamed",
    "bisim_class_count": f"WITH {_BISIM_CUST} SELECT count(DISTINCT cls) AS classes FROM knamed",
    "quotient_edges_conv": f"WITH {_SUFFIX} SELECT a.cls AS src, label, b.cls AS dst, count(*) AS n FROM conv JOIN cnamed a ON a.pid = src JOIN cnamed b ON b.pid = dst WHERE a.pid = a.cls GROUP BY ALL",
    "start_pairs": f"WITH {_NAT} SELECT a.pid AS p, b.pid AS q FROM nsets a JOIN nsets b ON a.enabled = b.enabled AND a.pid <> b.pid",
    "start_pairs_subset": f"WITH {_NAT} SELECT a.pid AS p, b.pid AS q FROM nsets a JOIN nsets b ON a.enabled = b.enabled AND a.pid <> b.pid WHERE a.pid < 1000 AND b.pid < 1000",
    "attack_moves": f"""WITH {_NAT}, seeds AS (SELECT a.pid AS p, b.pid AS q FROM nsets a JOIN nsets b ON a.enabled = b.enabled AND a.pid <> b.pid),
img AS (SELECT p, q, x.dst AS p2, coalesce((SELECT string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) FROM (SELECT DISTINCT y.dst AS d FROM nat y WHERE y.src = q AND y.label = x.label)), '') AS q2, EXISTS (SELECT 1 FROM nat y WHERE y.src = q AND y.label = x.label AND y.dst = x.dst) AS back FROM seeds JOIN nat x ON x.src = p)
SELECT 'A:' || p || ':' || q AS src, CAST(0 AS BIGINT) AS upd, 'A:' || p2 || ':' || q2 AS dst FROM img WHERE NOT back UNION ALL SELECT 'A:' || p || ':' || q, 1, 'D:' || p || ':' || q || ':' FROM seeds""",
    "defend_moves": f"WITH {_NAT} SELECT 'D:' || a.pid || ':' || b.pid || ':' AS src, CAST(2 AS BIGINT) AS upd, 'C:' || a.pid || ':' || b.pid AS dst FROM nsets a JOIN nsets b ON a.enabled = b.enabled AND a.pid <> b.pid",
    "clause_moves": f"WITH {_NAT}, s AS (SELECT a.pid AS p, b.pid AS q FROM nsets a JOIN nsets b ON a.enabled = b.enabled AND a.pid <> b.pid) SELECT 'C:' || p || ':' || q AS src, CAST(4 AS BIGINT) AS upd, 'A:' || p || ':' || q AS dst FROM s UNION ALL SELECT 'C:' || p || ':' || q, 5, 'A:' || q || ':' || p FROM s",
    "energy_pack": f"WITH {_VEC} SELECT pid, CAST({' + '.join(f'{e} * {4**i}' for i, e in enumerate(_ES))} AS BIGINT) AS word, '(' || replace(concat_ws(', ', {', '.join(_ES)}), '3', '∞') || ')' AS shown FROM vec",
    "energy_order": f"WITH {_VEC} SELECT a.pid, CAST(CASE WHEN {_LE} AND {_GE} THEN 0 WHEN {_LE} THEN -1 WHEN {_GE} THEN 1 END AS BIGINT) AS ord FROM vec a JOIN vec b ON b.pid = a.pid + 1",
    "inverse_update": f"WITH {_VEC}, u AS (SELECT pid, least(e1 + 1, 3) AS e1, e2, e3, e4, e5, least(e6 + 1, 3) AS e6 FROM vec), v AS (SELECT pid, greatest(e1, e3) AS e1, e2, e3, e4, greatest(e5, e4) AS e5, e6 FROM u) SELECT pid, concat_ws(',', {', '.join(_ES)}) AS e FROM v",
    "supremum": f"WITH {_VEC} SELECT a.pid, concat_ws(',', {', '.join(f'greatest(a.{e}, b.{e})' for e in _ES)}) AS e FROM vec a JOIN vec b ON b.pid = a.pid + 1",
    "notion_test": f"WITH {_VEC} " + " UNION ALL ".join(f"SELECT '{n}' AS notion, CAST(count(*) FILTER (WHERE NOT ({' AND '.join(f'{e} <= {x}' for e, x in zip(_ES, v, strict=True))})) AS BIGINT) AS held FROM vec" for n, v in E.NOTIONS.items()),
    "skyline": f"WITH {_VEC}, d AS (SELECT DISTINCT p_brand, {', '.join(_ES)} FROM vec) SELECT p_brand, concat_ws(',', {', '.join(_ES)}) AS e FROM d b WHERE NOT EXISTS (SELECT 1 FROM d a WHERE a.p_brand = b.p_brand AND {_LE} AND NOT ({_GE}))",
    "solve_diamond": _diamonds("SELECT CAST(p_partkey AS BIGINT) * 4 AS pos, p_size % 6 AS a, p_partkey % 6 AS b, (p_partkey // 6) % 6 AS c FROM part"),
    "game_json": _diamonds("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) * 4 AS pos, s_nationkey % 6 AS a, s_suppkey % 6 AS b, (s_suppkey // 6) % 6 AS c FROM supplier"),
    "solve_ladder": "WITH r AS (SELECT CAST(s_suppkey AS BIGINT) AS k, s_nationkey % 3 + 1 AS n, unnest(range(0, CAST(s_nationkey % 3 + 2 AS BIGINT))) AS r FROM supplier) SELECT k * 8 + r AS pos, concat_ws(',', " + ", ".join(f"(SELECT count(*) FROM range(r, n) t(x) WHERE (k + x) % 6 = {i})" for i in range(6)) + ") AS e FROM r",
    "solve_orders": f"WITH {_ORDER_GAME}, {_ORDER_WON} SELECT pos, {_bits('x')} AS e FROM won a WHERE NOT EXISTS (SELECT 1 FROM won b WHERE b.pos = a.pos AND b.x <> a.x AND b.x & a.x = b.x) UNION ALL SELECT pos, '0,0,0,0,0,0' FROM free",
    "solve_least_cost": "WITH RECURSIVE m AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_acctbal < 0 AS free FROM customer), s AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS cost UNION ALL SELECT k + 1, cost + CASE WHEN free THEN 0 ELSE 1 END FROM s JOIN m ON s.pos = CASE WHEN k % 5 = 0 THEN 0 ELSE k + 2 END) SELECT pos, CAST(cost AS VARCHAR) AS e FROM s",
    "reach_targets": f"WITH {_ORDER_GAME} SELECT pos FROM free",
    "reverse_moves": "SELECT CAST(o_custkey AS BIGINT) * 4 + 1 AS src, CAST(o_orderkey AS BIGINT) * 4 + 2 AS dst FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)",
    "solve_reach": "WITH o AS (SELECT CAST(o_custkey AS BIGINT) AS c, CAST(o_orderkey AS BIGINT) AS o, o_orderstatus = 'F' AS done FROM orders) SELECT o * 4 + 2 AS pos, '0,0,0,0,0,0' AS e FROM o WHERE done UNION ALL SELECT c * 4 + 1, '0,0,0,0,0,0' FROM o GROUP BY c HAVING bool_and(done)",
    "compare_pair": _compared("<"),
    "compare_pair_back": _compared(">"),
    "relation_traces_conv": f"WITH {_SUFFIX} SELECT pid, cls AS class_id FROM cnamed",
    "classes_bisimulation_conv": f"WITH {_SUFFIX} SELECT cls AS class_id, count(*) AS size FROM cnamed GROUP BY cls",
    "report_conv": f"WITH {_SUFFIX} SELECT notion, CASE WHEN notion = 'enabledness' THEN (SELECT count(DISTINCT split_part(s, ',', 1)) FROM suffix) ELSE (SELECT count(DISTINCT s) FROM suffix) END AS classes FROM (VALUES " + ", ".join(f"('{n}')" for n in E.NOTIONS) + ") AS t(notion)",
    "preorder_simulation_nat": f"WITH {_NAT} SELECT p, q FROM below",
    "preorder_traces_nat": f"WITH {_NAT} SELECT p, q FROM below",
    "relation_enabledness_nat": f"WITH {_NAT} SELECT pid, min(pid) OVER (PARTITION BY enabled) AS class_id FROM nsets",
    "relation_simulation_nat": _named("simkey"),
    "relation_bisimulation_nat": _named("bikey"),
    "report_nat": f"WITH {_NAT} SELECT 'enabledness' AS notion, count(DISTINCT enabled) AS classes FROM nsets UNION ALL SELECT 'traces', count(DISTINCT k) FROM simkey UNION ALL SELECT 'simulation', count(DISTINCT k) FROM simkey UNION ALL SELECT 'bisimulation', count(DISTINCT k) FROM bikey",
    "lts_edges_parcel": f"WITH {_PARCEL} SELECT src, dst, label FROM parcel",
    "universe_nat": f"WITH {_NAT} SELECT unnest(range(0, (SELECT max(greatest(src, dst)) FROM nat) + 1)) AS pid",
    "adjacency_nat": f"WITH {_NAT} SELECT label, dst, (SELECT max(greatest(src, dst)) FROM nat) + 1 AS states FROM nat WHERE src = 1",
    "json_round_trip": f"WITH {_NAT}, d AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS n FROM (SELECT DISTINCT label FROM nat)) SELECT src, dst, CAST(n AS INTEGER) AS label FROM nat JOIN d USING (label)",
    "bisim_classes_evt": f"WITH {_BISIM_EVT} SELECT pid, cls FROM r{_ROUNDS}",
    "bisim_classes_parcel": f"WITH {_FAMILY} SELECT pid, min(pid) OVER (PARTITION BY readiness) AS cls FROM pkey",
    "class_numbers": f"WITH {_FAMILY}, c AS (SELECT pid, min(pid) OVER (PARTITION BY readiness) AS cls FROM pkey) SELECT pid, dense_rank() OVER (ORDER BY cls) - 1 AS number FROM c",
    "quotient_edges_parcel": f"WITH {_FAMILY}, c AS (SELECT pid, min(pid) OVER (PARTITION BY readiness) AS cls FROM pkey) SELECT a.cls AS src, label, b.cls AS dst, count(*) AS n FROM parcel JOIN c a ON a.pid = src JOIN c b ON b.pid = dst WHERE a.pid = a.cls GROUP BY ALL",
    "split_moves": f"WITH {_SPLITS} SELECT src, CAST(1 AS BIGINT) AS upd, 'D:' || conj.p || ':' || q || ':' || qx AS dst FROM conj JOIN start USING (o) UNION ALL SELECT src, 0, 'A:' || o || ':' FROM start, (VALUES (1), (2), (4)) AS t(f) WHERE pm & f > 0 AND qm & f = 0",
    "revival_moves": f"WITH {_SPLITS}, d AS (SELECT 'D:' || p || ':' || q || ':' || qx AS src, p, q, qx FROM conj) SELECT src, CAST(2 AS BIGINT) AS upd, 'C:' || p || ':' || unnest(string_split(q, ',')) AS dst FROM d UNION ALL SELECT src, 3, 'A:' || p || ':' || qx FROM d WHERE qx <> ''",
    "report_evt": f"WITH {_EVT_MORE} SELECT notion, CAST(CASE notion WHEN 'enabledness' THEN count(DISTINCT coalesce(array_to_string(ls, ','), '')) ELSE count(*) END AS BIGINT) AS classes FROM els, (VALUES {', '.join(f"('{n}')" for n in E.NOTIONS)}) AS t(notion) GROUP BY notion",
    "relation_traces_evt": f"WITH {_BISIM_EVT} SELECT pid, cls AS class_id FROM r{_ROUNDS}",
    "preorders_simulation_evt": f"WITH {_EVT_MORE} SELECT a.cls AS p, b.cls AS q FROM els a JOIN els b ON coalesce(a.ls, []) = coalesce(b.ls, []) AND a.cls <> b.cls ANTI JOIN more ON more.p = a.cls AND more.q = b.cls",
    "game_size_parcel": f"WITH {_GAME_PARCEL} SELECT what, CAST(n AS BIGINT) AS n FROM sizes WHERE n > 0",
    "game_size_conv": f"WITH {_GAME_CONV}, n AS (SELECT kind, x >= 0 AS has, count(*) AS n FROM pos GROUP BY ALL) SELECT 'positions ' || kind AS what, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY kind UNION ALL SELECT 'moves 0', {_OBS_CONV} UNION ALL SELECT 'moves 1', CAST(sum(n) AS BIGINT) FROM n WHERE kind = 'A' UNION ALL SELECT 'moves 2', CAST(sum(n) AS BIGINT) FROM n WHERE kind = 'D' AND has UNION ALL SELECT 'moves 4', (SELECT count(*) FROM pos WHERE kind = 'C' AND p <> x) UNION ALL SELECT 'moves 5', (SELECT count(*) FROM pos WHERE kind = 'C' AND p <> x)",
    "wide_algebra": f"WITH {_VEC}, s AS (SELECT a.pid, {', '.join(f'greatest(a.{e}, b.{e}) AS {e}' for e in _ES)} FROM vec a JOIN vec b ON b.pid = a.pid + 1), u AS (SELECT pid, e1 + 1 AS e1, e2, e3, e4, e5, e6 + 1 AS e6 FROM s) SELECT pid, concat_ws(',', greatest(e1, e3), e2, e3, e4, greatest(e5, e4), e6) AS e FROM u",
    "word_round_trip": f"WITH {_VEC} SELECT pid, concat_ws(',', {', '.join(_ES)}) AS energy, CAST({' + '.join(f'(CASE {e} WHEN 3 THEN 1 WHEN 0 THEN 0 ELSE {e} + 1 END) * {16**i}' for i, e in enumerate(_ES))} AS BIGINT) AS word, concat_ws(',', {', '.join(f'CASE {e} WHEN 3 THEN -1 ELSE {e} END' for e in _ES)}) AS upd, '(' || concat_ws(', ', {', '.join(f"CASE {e} WHEN 3 THEN '-' WHEN 0 THEN '0' ELSE 'm' || {e} END" for e in _ES)}) || ')' AS shown FROM vec",
    "energy_sets": f"WITH {_VEC} SELECT a.pid, CAST(2 AS BIGINT) AS n, concat_ws(',', {', '.join(f'b.{e}' for e in _ES)}) AS first, true AS same, '[(' || replace(concat_ws(', ', {', '.join(f'a.{e}' for e in _ES)}), '3', '∞') || ')' || chr(10) || '(' || replace(concat_ws(', ', {', '.join(f'b.{e}' for e in _ES)}), '3', '∞') || ')]' AS shown FROM vec a JOIN vec b ON b.pid = a.pid + 1",
    "spectrum_report": f"WITH {_FAMILY} " + " UNION ALL ".join(f"SELECT '{n}' AS notion, count(DISTINCT {'m' if n == 'enabledness' else _TOLD.get(n, 'readiness')}) AS classes FROM pkey" for n in E.NOTIONS),
    "spectrum_report_nat": f"WITH {_NAT} " + " UNION ALL ".join("SELECT 'enabledness' AS notion, count(DISTINCT enabled) AS classes FROM nsets" if n == "enabledness" else f"SELECT '{n}', count(DISTINCT k) FROM {'simkey' if n in ('traces', 'simulation') else 'bikey'}" for n in E.NOTIONS),
    "relation_traces_parcel": _parcel_named("traces"),
    "relation_simulation_parcel": _parcel_named("simulation"),
    "relation_failures_parcel": _parcel_named("failures"),
    "relation_revivals_parcel": _parcel_named("revivals"),
    "relation_readiness_parcel": _parcel_named("readiness"),
    "bound_energies": _parcel_named("revivals"),
    "classes_failure_traces_parcel": f"WITH {_FAMILY} SELECT min(pid) AS class_id, count(*) AS size FROM pkey GROUP BY revivals",
    "preorders_simulation_parcel": _parcel_below("EXISTS (SELECT 1 FROM member s WHERE s.fam = x.fam AND NOT EXISTS (SELECT 1 FROM member t WHERE t.fam = y.fam AND s.m & t.m = s.m))", "(p.m = 0) = (q.m = 0) AND p.m & q.m = p.m"),
    "preorders_failures_parcel": _parcel_below("EXISTS (SELECT 1 FROM member s WHERE s.fam = x.fam AND NOT EXISTS (SELECT 1 FROM member t WHERE t.fam = y.fam AND s.m & t.m = t.m)) OR (SELECT bit_or(m) FROM member s WHERE s.fam = x.fam) & ~(SELECT bit_or(m) FROM member t WHERE t.fam = y.fam) <> 0"),
    "equivalents_traces_parcel": f"WITH {_FAMILY} SELECT a.cls AS p, b.cls AS q FROM prep a JOIN prep b ON a.traces = b.traces AND a.cls <> b.cls",
    "class_of_parcel": f"WITH {_FAMILY}, r AS (SELECT pid, min(pid) OVER (PARTITION BY failures) AS c FROM pkey) SELECT pid FROM r WHERE c = (SELECT min(pid) FROM pkey)",
    "unminimized_nat": f"WITH {_NAT} SELECT p, q FROM below WHERE p < 1000 AND q < 1000",
    "attack_alone": f"""WITH {_GAME_CONV}, m AS (SELECT p, x FROM pos WHERE kind = 'A' AND x >= 0 ORDER BY p, x LIMIT 1),
obs AS (SELECT pos.p, pos.x, n.nxt AS p2, CASE WHEN o.label = n.label THEN o.nxt ELSE -1 END AS x2 FROM pos JOIN q n ON n.p = pos.p LEFT JOIN q o ON o.p = pos.x WHERE pos.kind = 'A' AND pos.x >= 0 AND NOT (coalesce(o.label = n.label, false) AND o.nxt = n.nxt))
SELECT 'out' AS way, CAST(1 AS BIGINT) AS upd FROM m UNION ALL SELECT 'out', 0 FROM obs JOIN m USING (p, x) UNION ALL SELECT 'in', 0 FROM obs JOIN m ON p2 = m.p AND x2 = m.x
UNION ALL SELECT 'in', 4 FROM pos JOIN m USING (p, x) WHERE kind = 'C' UNION ALL SELECT 'in', 5 FROM pos JOIN m ON pos.p = m.x AND pos.x = m.p WHERE kind = 'C'""",
    "relation_union": f"""WITH RECURSIVE {_FAMILY}, c AS MATERIALIZED (SELECT pid, min(pid) OVER (PARTITION BY failures) AS cls FROM pkey),
l AS MATERIALIZED (SELECT DISTINCT a.cls AS u, b.cls AS v FROM c a JOIN c b ON b.pid = a.pid + 1 WHERE a.pid % 64 = 1), e AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach AS (SELECT DISTINCT cls AS u, cls AS v FROM c UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v) SELECT pid, class_id FROM c JOIN (SELECT u AS cls, min(v) AS class_id FROM reach GROUP BY u) USING (cls)""",
}
ORACLE_SQL["text_files"] = ORACLE_SQL["text_edges"]
