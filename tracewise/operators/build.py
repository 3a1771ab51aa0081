"""The comparison game of an LTS: positions reachable from the seeds, and moves between them.

A position is called by a number, a 64-bit hash of its kind, its state and its sets, so that positions and moves are of fixed width however
large the sets are. A second hash beside it tells positions of equal numbers apart while the game is built; if there are any, the game is built
again with other hashes. So two positions are taken for one only if 128 bits agree. ``spelled`` gives a position in full. Moves carry one of
six updates.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.operators.refine import compare_enabled, enabled_sets
from tracewise.plans.iterate import cut, dealt_by, union_all

#: The updates of the game's moves.
OBSERVATION, CONJUNCTION, ANSWER, REVIVAL, POSITIVE, NEGATIVE = range(6)
UPDATES = {
    OBSERVATION: (-1, 0, 0, 0, 0, 0),
    CONJUNCTION: (0, -1, 0, 0, 0, 0),
    ANSWER: (0, 0, 0, 3, 0, 0),
    REVIVAL: (3, 0, 0, 0, 0, 0),
    POSITIVE: (4, 0, 0, 0, 0, 0),
    NEGATIVE: (5, 0, 0, 0, 0, -1),
}
#: The way of a single state to the comparison the other way round: updates one after the other.
ACROSS = 6
#: The ways to a position that is told by a label that p has and no state of Q: by an observation or across, and then that label.
LOST, LOST_ACROSS = 7, 8
WAYS = {ACROSS: (CONJUNCTION, ANSWER, NEGATIVE), LOST: (OBSERVATION, OBSERVATION), LOST_ACROSS: (CONJUNCTION, ANSWER, NEGATIVE, OBSERVATION)}

def _none() -> Column:
    return F.array().cast("array<bigint>")


def position(kind: str, p: Column, q: Column, qx: Column | None = None, seed: int = 0) -> Column:
    """A struct (pos, mark, kind, p, q, qx)."""
    qx = _none() if qx is None else qx
    # a hash of arrays runs on from one to the next, so their sizes are hashed too
    number = lambda half: F.xxhash64(F.lit(2 * seed + half), F.lit(kind), p.cast("bigint"), F.size(q), q.cast("array<bigint>"), qx.cast("array<bigint>"))
    parts = [F.lit(kind).alias("kind"), p.cast("bigint").alias("p"), q.cast("array<bigint>").alias("q"), qx.cast("array<bigint>").alias("qx")]
    return F.struct(number(0).alias("pos"), number(1).alias("mark"), *parts)


def attack(p: Column, q: Column, seed: int = 0) -> Column:
    return position("A", p, q, seed=seed)


def defend(p: Column, q: Column, qx: Column, seed: int = 0) -> Column:
    return position("D", p, q, qx, seed)


def clause(p: Column, q: Column, seed: int = 0) -> Column:
    return position("C", p, F.array(q), seed=seed)


def spelled(at: str | None = None) -> Column:
    """The position in the struct ``at`` (or in columns) in full: ``A:p:q,..`` (attack), ``C:p:q`` (clause), ``D:p:q,..:qx,..`` (defend)."""
    of = lambda name: F.col(f"{at}.{name}" if at else name)
    listed = lambda name: F.array_join(of(name).cast("array<string>"), ",")
    return F.concat_ws(":", of("kind"), of("p").cast("string"), listed("q"), F.when(of("kind") == "D", listed("qx")))


def _move(update: int, to: Column) -> list[Column]:
    return [F.col("pos").alias("src"), F.lit(update).alias("upd"), to.alias("to")]


def attack_moves(frontier: DataFrame, edges: DataFrame, seed: int = 0, beside: tuple[str, ...] = (), apart: bool = True) -> DataFrame:
    """(src, upd, to) of attack positions: observations, and conjunctions with up to four splits of Q. Columns ``beside`` of the frontier
    stand beside each move.

    Positions of a single state are worked ``apart``, which saves where there are many; if not, all are worked in one way."""
    at = frontier.where("kind = 'A'")
    moves = [at.where(F.size("q") == 0).select(*beside, *_move(CONJUNCTION, defend(F.col("p"), _none(), _none(), seed)))]
    at = at.where(F.size("q") > 0)
    unseen = lambda rows: rows.where(~F.array_contains("q2", F.col("p2"))).select(*beside, *_move(OBSERVATION, attack(F.col("p2"), F.col("q2"), seed)))

    if apart:  # of a single state the targets are known by state and label, and there is nothing to split
        one, at = at.where(F.size("q") == 1), at.where(F.size("q") > 1)
        led = edges.groupBy(F.col("src").alias("q"), "label").agg(F.sort_array(F.collect_set("dst")).alias("q2"))
        alone = one.select("pos", *beside, F.col("p").alias("src"), F.col("q")[0].alias("q")).join(edges, "src").select("pos", *beside, "q", "label", F.col("dst").alias("p2")).join(led, ["q", "label"], "left")
        moves.append(unseen(alone.withColumn("q2", F.coalesce("q2", _none()))))
        moves.append(one.select(*beside, *_move(CONJUNCTION, defend(F.col("p"), F.col("q"), _none(), seed))))

    # p and the states of Q meet their edges in one join, and a position's rows are brought together once
    member = lambda state, own: F.struct(state.alias("state"), F.lit(own).alias("own"))
    members = F.concat(F.array(member(F.col("p"), True)), F.transform("q", lambda x: member(x, False)))
    met = at.select("pos", *beside, F.explode(members).alias("m")).select("pos", "m.*", *[F.when(F.col("m.own"), F.col(c)).alias(c) for c in beside])
    rows = vars(edges).get("rows")  # as ``cut`` has counted
    met = dealt_by(met, rows, "state").join(dealt_by(edges.select(F.col("src").alias("state"), "label", "dst"), rows, "state"), "state", "left")
    # packed until they are dealt, so that no column is left out for one of the plans below and both read the same shuffle
    met = met.select("pos", F.array(F.struct("state", "own", "label", "dst", *beside)).alias("row"))
    met = dealt_by(met, rows, "pos", always=True).select("pos", F.inline("row"))
    kept = [F.max(c).alias(c) for c in beside]

    step = F.when(F.col("own"), F.col("dst"))
    image = F.when(~F.col("own") & F.col("label").isNotNull(), F.col("dst"))
    seen = met.groupBy("pos", "label").agg(F.collect_list(step).alias("steps"), F.sort_array(F.collect_set(image)).alias("q2"), *kept)
    moves.append(unseen(seen.select("pos", *beside, "q2", F.explode("steps").alias("p2"))))

    whole = Window.partitionBy("pos")
    each = met.groupBy("pos", "state", "own").agg(F.collect_set("label").alias("enabled"), *kept)
    of = lambda name: F.max(F.when(F.col("own"), F.col(name))).over(whole)
    each = each.select("pos", "own", F.col("state").alias("x"), F.col("enabled").alias("i_x"), of("state").alias("p"), of("enabled").alias("i_p"), *[of(c).alias(c) for c in beside]).where("NOT own")
    within, beyond = compare_enabled("i_p", "i_x")
    each = each.groupBy("pos", "p", *beside).agg(F.sort_array(F.collect_set(F.struct("x", within.alias("le"), beyond.alias("ge")))).alias("x"))
    chosen = lambda ok: F.struct(F.transform(F.filter("x", lambda s: ~ok(s)), lambda s: s["x"]).alias("q"), F.transform(F.filter("x", ok), lambda s: s["x"]).alias("qx"))
    splits = F.array(chosen(lambda s: s["le"]), chosen(lambda s: s["ge"]), chosen(lambda s: s["le"] & s["ge"]))
    plain = F.array(F.struct(F.transform("x", lambda s: s["x"]).alias("q"), _none().alias("qx")))
    splits = F.concat(plain, F.array_distinct(F.filter(splits, lambda s: (F.size(s["q"]) > 0) & (F.size(s["qx"]) > 0))))
    moves.append(each.select("pos", "p", *beside, F.explode(splits).alias("s")).select(*beside, *_move(CONJUNCTION, defend(F.col("p"), F.col("s.q"), F.col("s.qx"), seed))))
    return union_all(moves)


def defend_moves(frontier: DataFrame, seed: int = 0) -> DataFrame:
    """(src, upd, to) of defend positions: an answer for each of Q, and a revival of Q*."""
    at = frontier.where("kind = 'D'")
    answers = at.select("pos", "p", F.explode("q").alias("x")).select(*_move(ANSWER, clause(F.col("p"), F.col("x"), seed)))
    return answers.unionByName(at.where(F.size("qx") > 0).select(*_move(REVIVAL, attack(F.col("p"), F.col("qx"), seed))))


def clause_moves(frontier: DataFrame, seed: int = 0) -> DataFrame:
    """(src, upd, to) of clause positions: both ways round."""
    at = frontier.where("kind = 'C'").select("pos", "p", F.col("q")[0].alias("x"))
    both = F.array(F.struct(F.lit(POSITIVE).alias("upd"), attack(F.col("p"), F.array("x"), seed).alias("to")), F.struct(F.lit(NEGATIVE).alias("upd"), attack(F.col("x"), F.array("p"), seed).alias("to")))
    return at.where("p <> x").select(F.col("pos").alias("src"), F.inline(both))


class Game:
    """``positions`` (pos, is_attack) and ``moves`` (src, dst, upd). ``upd`` is the update itself, an array, or a number of one in
    ``updates``. ``seed`` is that of the hashes that call the positions of a comparison."""

    def __init__(self, positions: DataFrame, moves: DataFrame, updates: dict[int, tuple] | None, conf, seed: int = 0, ways: dict[int, tuple] | None = None) -> None:
        self.positions, self.moves, self.updates, self.conf, self.seed = positions, moves, updates, conf, seed
        #: Numbers that stand for several of ``updates``, one after the other.
        self.ways = ways or {}
        #: How many moves there are, where it is known.
        self.rows: int | None = None
        #: The same game by fewer positions, where it is known: those it keeps have the same energies.
        self.short: Game = self

    @property
    def lean(self) -> Game:
        """The same game by fewer positions still, where it is known: only the seeds need have the same energies."""
        return self.short

    def update_data(self) -> DataFrame:
        """(src, dst, upd) with updates as arrays."""
        if self.updates is None:
            return self.moves
        known = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, u)).alias("u")) for k, u in self.updates.items()])
        return self.moves.withColumn("upd", F.element_at(F.map_from_entries(known), F.col("upd")))

    def n_vertices(self) -> int:
        return self.positions.count()

    def adj(self, pos) -> DataFrame:
        return self.moves.where(F.col("src") == pos)

    def reverse(self, pos) -> DataFrame:
        return self.moves.where(F.col("dst") == pos)


def seeds(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """Attack positions of pairs (p, q)."""
    return pairs.select(attack(F.col("p"), F.array("q"), seed).alias("to")).select("to.*").dropDuplicates(NAMES)


#: What tells positions apart: the number, and the hash beside it.
NAMES = ["pos", "mark"]

#: Position tables that are merged into one when there are more: the search for known positions reads all of them.
TABLES = 6


class _Known:
    """Names of positions met so far, as a few tables."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def new(self, candidates: DataFrame, split: str | None = None) -> DataFrame:
        """The distinct positions among ``candidates`` that were not met before; they count as met from now on."""
        found = candidates.dropDuplicates(NAMES)
        if self.tables:
            found = found.join(union_all(self.tables), NAMES, "left_anti")
        found = cut(found, split)
        self.tables.append(found.select(NAMES))
        if len(self.tables) > TABLES:
            self.tables = [cut(union_all(self.tables))]
        return found


def _onward(step: DataFrame, seed: int) -> DataFrame:
    """Attack positions that the moves (to) of attack positions lead to: at once, by revival, or over an answer and its clause."""
    p = F.col("to.p")
    one = lambda a, b: attack(a, F.array(b), seed)
    asked = F.filter("to.q", lambda x: x != p)
    over = F.concat(F.transform(asked, lambda x: one(p, x)), F.transform(asked, lambda x: one(x, p)))
    revived = F.when(F.size("to.qx") > 0, F.array(attack(p, F.col("to.qx"), seed)))
    return step.select(F.explode(F.when(F.col("to.kind") == "A", F.array("to")).otherwise(F.concat(over, F.coalesce(revived, F.slice(over, 1, 0))))).alias("to")).select("to.*")


def build(edges: DataFrame, states: DataFrame, pairs: DataFrame, max_positions: int | None = None) -> Game:
    """The game from the pairs' attack positions, breadth first.

    A round finds the attack positions next reached, over defend positions and clauses, and writes these alone. Then the moves of all attack
    positions are made at once; defend positions belong to one attack position each, and their moves and those of clauses are told by the
    position, so they are not written. The labels of states are told by their edges, so ``states`` is not read. ``short`` of the game leaves out defenders of one state and their clauses: its attack positions have the same
    energies. Where no bound asks for its size, the game is made when its positions or moves are first read; ``lean`` is made without it."""
    if max_positions is None:
        return _Comparison(edges, pairs)
    return _first(lambda seed: _built(edges, pairs, max_positions, seed))


def _first(made) -> Game:
    """The game of the first seed that gives all positions different numbers."""
    seed = 0
    while (game := made(seed)) is None:
        seed += 1
    return game


class _Comparison(Game):
    """The game of ``pairs``, whole and lean, each made when it is first asked for."""

    def __init__(self, edges: DataFrame, pairs: DataFrame) -> None:
        self.edges, self.pairs = edges, pairs
        self.updates, self.ways, self.rows = UPDATES, {}, None

    whole = cached_property(lambda self: _first(lambda seed: _built(self.edges, self.pairs, None, seed)))
    lean = cached_property(lambda self: _first(lambda seed: _lean(self.edges, self.pairs, seed)))
    positions = property(lambda self: self.whole.positions)
    moves = property(lambda self: self.whole.moves)
    conf = property(lambda self: self.whole.conf)
    seed = property(lambda self: self.whole.seed)
    short = property(lambda self: self.whole.short)


def _distinct(named: list[DataFrame]) -> bool:
    """Whether positions of these names that differ have different numbers."""
    return not union_all([n.select(NAMES) for n in named]).groupBy("pos").agg((F.min("mark") != F.max("mark")).alias("differ")).where("differ").limit(1).count()


def _single_moves(at: DataFrame, ends: DataFrame, led: DataFrame, seed: int) -> DataFrame:
    """(src, upd, to, more) of attack positions of a single state, for ``_lean``. ``ends`` are the edges with the labels of their targets, ``led`` the
    targets of a state by label with all their labels."""
    at = at.select("pos", "p", F.col("q")[0].alias("x"), "more")
    nothing = lambda p: attack(p, _none(), seed)
    none = F.array().cast(ends.schema["enabled"].dataType)
    seen = at.select("pos", F.col("p").alias("src"), "x").join(ends, "src").join(led, ["x", "label"], "left")
    seen = seen.select("pos", F.col("dst").alias("p2"), "enabled", F.coalesce("q2", _none()).alias("q2"), F.coalesce("all", none).alias("all")).where(~F.array_contains("q2", F.col("p2")))
    lost, more = F.size(F.array_except("enabled", "all")) > 0, F.size(F.array_except("all", "enabled")) > 0
    seen = seen.withColumn("lost", (F.size("q2") > 0) & lost).withColumn("more", (F.size("q2") == 1) & ~F.col("lost") & more)
    onward = F.when(F.col("lost"), nothing(F.col("p2"))).otherwise(attack(F.col("p2"), F.col("q2"), seed))
    seen = seen.select(F.col("pos").alias("src"), F.when(F.col("lost"), LOST).otherwise(OBSERVATION).alias("upd"), onward.alias("to"), "more")
    back = F.when(F.col("more"), nothing(F.col("x"))).otherwise(attack(F.col("x"), F.array("p"), seed))
    across = at.where("p <> x").select(F.col("pos").alias("src"), F.when(F.col("more"), LOST_ACROSS).otherwise(ACROSS).alias("upd"), back.alias("to"), F.lit(False).alias("more"))
    return seen.unionByName(across)


def _lean(edges: DataFrame, pairs: DataFrame, seed: int) -> Game | None:
    """The short game without positions of known energies; none if two of its positions have the same number.

    Each win takes an observation and a conjunction, or from no Q a conjunction. So from an attack position without Q the conjunction alone is least, and from one whose p has
    a label that no state of Q has, this label and then the conjunction: what else such a position has is left out. Moves of
    single states to the latter lead on to p without Q by one update. ``more`` says of a position that its single state has labels that p has not, and so is
    told from p the other way round."""
    from tracewise.functions.energy import STANDARD

    own = edges.groupBy(F.col("src").alias("dst")).agg(F.sort_array(F.collect_set("label")).alias("enabled"))
    empty = F.array().cast(own.schema["enabled"].dataType)
    ends = cut(edges.join(own, "dst", "left").select("src", "label", "dst", F.coalesce("enabled", empty).alias("enabled")))
    led = ends.groupBy(F.col("src").alias("x"), "label").agg(F.sort_array(F.collect_set("dst")).alias("q2"), F.array_distinct(F.flatten(F.collect_set("enabled"))).alias("all"))
    led = cut(led)

    attacks = _Known()
    several = lambda rows: rows.withColumn("several", F.size("q") > 1)
    new = attacks.new(several(seeds(pairs, seed).withColumn("more", F.lit(False))), "several")
    found, many = [new], 0
    while new.all_rows:
        many += new.rows
        step = _single_moves(new.where("size(q) = 1"), ends, led, seed).select("to.*", "more")
        if new.rows:
            step = step.unionByName(_onward(attack_moves(new.where("several"), edges, seed, apart=False), seed).withColumn("more", F.lit(False)))
        new = attacks.new(several(step), "several")
        found.append(new)
    every = union_all(found)
    alone = every.where("size(q) = 0").select("pos", defend(F.col("p"), _none(), _none(), seed).alias("to"))
    moves = [_single_moves(every.where("size(q) = 1"), ends, led, seed).select("src", "upd", F.col("to.pos").alias("dst")), alone.select(F.col("pos").alias("src"), F.lit(CONJUNCTION).alias("upd"), F.col("to.pos").alias("dst"))]
    every, others = every.select("pos", "mark", "kind", "p", "q", "qx"), [alone.select("to.*")]
    if many:
        step = cut(attack_moves(every.where("size(q) > 1"), edges, seed, apart=False))
        defends = step.where("to.kind = 'D'").select("to.*")
        clauses = cut(defend_moves(defends, seed).where("to.kind = 'C'").select("to.*").dropDuplicates(NAMES))
        others += [defends, clauses]
        moves += [m.select("src", "upd", F.col("to.pos").alias("dst")) for m in (step, defend_moves(defends, seed), clause_moves(clauses, seed))]
    if not _distinct([every, *others]):
        return None
    positions = union_all([every, *others]).select("pos", F.col("kind").isin("A", "C").alias("is_attack"), "kind", "p", "q", "qx")
    moves = cut(union_all(moves))
    game = Game(positions, moves, UPDATES, STANDARD, seed, WAYS)
    game.rows = moves.rows
    return game


def _built(edges: DataFrame, pairs: DataFrame, max_positions: int | None, seed: int) -> Game | None:
    """The game; none if two of its positions have the same number."""
    from tracewise.functions.energy import STANDARD

    def bounded(rows: int) -> None:
        if max_positions is not None and rows > max_positions:
            raise ValueError(f"the game has more than {max_positions} positions")

    attacks = _Known()
    new = attacks.new(seeds(pairs, seed))
    found, total = [new], new.rows
    while new.rows:
        bounded(total)
        new = attacks.new(_onward(attack_moves(new, edges, seed), seed))
        found.append(new)
        total += new.rows
    every = union_all(found)
    step = cut(attack_moves(every, edges, seed).withColumn("deep", F.col("to.kind") == "D"), "deep")
    total += step.rows
    bounded(total)
    defends = step.where("deep").select("to.*")
    answers = defend_moves(defends, seed)
    asked = answers.where("to.kind = 'C'").select("to.*")
    clauses = asked.dropDuplicates(NAMES)
    if max_positions is not None:
        bounded(total + clauses.count())
    if not _distinct([every, defends, asked]):
        return None

    def game(attacks: DataFrame, moves: DataFrame, defends: DataFrame, clauses: DataFrame, ways: dict) -> Game:
        positions = union_all([attacks, defends, clauses]).select("pos", F.col("kind").isin("A", "C").alias("is_attack"), "kind", "p", "q", "qx")
        moves = [moves] + [m.select("src", "upd", F.col("to.pos").alias("dst")) for m in (defend_moves(defends, seed), clause_moves(clauses, seed))]
        return Game(positions, union_all(moves), UPDATES, STANDARD, seed, ways)

    whole = game(every, step.select("src", "upd", F.col("to.pos").alias("dst")), defends, clauses, {})
    # A defender of one state has one answer, and its clause leads back to the attack or to the one the other way round; back only asks for more
    p, x = F.col("to.p"), F.col("to.q")[0]
    single = F.col("deep") & (F.size("to.q") == 1) & (F.size("to.qx") == 0)
    kept = step.where(~single)
    across = step.where(single).where(p != x).select("src", F.lit(ACROSS).alias("upd"), attack(x, F.array(p), seed)["pos"].alias("dst"))
    defends = kept.where("deep").select("to.*")
    clauses = defend_moves(defends, seed).where("to.kind = 'C'").select("to.*").dropDuplicates(NAMES)
    whole.short = game(every, kept.select("src", "upd", F.col("to.pos").alias("dst")).unionByName(across), defends, cut(clauses), WAYS)
    return whole


#: States of a class that are paired with as many others in one group, about.
TILE = 1024


def start_pairs(edges: DataFrame, states: DataFrame, subset: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(p, q): all ordered pairs of different states with equal enabled labels, of all or of ``subset`` (pid).

    Classes are counted first: if their pairs are more than ``most``, ValueError is raised before any pair is made. A class is dealt into tiles,
    and a group pairs two tiles, so that no group holds a class."""
    sets = enabled_sets(edges, states)
    if subset is not None:
        sets = sets.join(subset.select("pid"), "pid", "left_semi")
    sizes = sets.groupBy("enabled").agg(F.min("pid").alias("cls"), F.count("*").alias("n")).where("n > 1")
    if most is not None:
        pairs = sizes.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")), F.lit(0)).alias("pairs")).first().pairs
        if pairs > most:
            raise ValueError(f"the game has more than {most} positions: {pairs} pairs of states have equal enabled labels")
    tiles = F.ceil(F.col("n") / TILE)
    own = sets.join(sizes, "enabled").select("pid", "cls", F.pmod(F.xxhash64("pid"), tiles).alias("tile"), F.sequence(F.lit(0).cast("bigint"), tiles - 1).alias("others"))
    left = own.select(F.col("pid").alias("p"), "cls", F.col("tile").alias("a"), F.explode("others").alias("b"))
    right = own.select(F.col("pid").alias("q"), "cls", F.col("tile").alias("b"), F.explode("others").alias("a"))
    return left.join(right, ["cls", "a", "b"]).where("p <> q").select("p", "q")


def wider_pairs(edges: DataFrame, states: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """(p, q): all pairs of states, of all or of ``subset`` (pid), where q has all enabled labels of p and more. Sets of labels are compared, and
    states are dealt into tiles as in ``start_pairs``."""
    sets = enabled_sets(edges, states)
    if subset is not None:
        sets = sets.join(subset.select("pid"), "pid", "left_semi")
    sets = cut(sets)
    sizes = cut(sets.groupBy("enabled").agg(F.min("pid").alias("cls"), F.ceil(F.count("*") / TILE).alias("tiles")))
    side = lambda k: sizes.select(*[F.col(c).alias(f"{c}_{k}") for c in ("enabled", "cls", "tiles")])
    within, beyond = compare_enabled("enabled_b", "enabled_a")
    links = cut(side("a").crossJoin(side("b")).where(within & ~beyond).select("cls_a", "tiles_a", "cls_b", "tiles_b"))
    own = sets.join(sizes, "enabled").select("pid", "cls", F.pmod(F.xxhash64("pid"), F.col("tiles")).alias("tile"))
    upto = lambda tiles: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(tiles) - 1))
    left = own.select(F.col("pid").alias("p"), F.col("cls").alias("cls_a"), F.col("tile").alias("a")).join(links, "cls_a").select("p", "cls_a", "cls_b", "a", upto("tiles_b").alias("b"))
    right = own.select(F.col("pid").alias("q"), F.col("cls").alias("cls_b"), F.col("tile").alias("b")).join(links, "cls_b").select("q", "cls_a", "cls_b", "b", upto("tiles_a").alias("a"))
    return left.join(right, ["cls_a", "cls_b", "a", "b"]).select("p", "q")


def show_position(kind: str = "kind", p: str = "p", q: str = "q", qx: str = "qx") -> Column:
    """Text of a position."""
    listed = lambda a: F.concat(F.lit("{"), F.array_join(F.col(a).cast("array<string>"), ", "), F.lit("}"))
    return F.when(F.col(kind) == "A", F.concat(F.lit("("), F.col(p), F.lit(", "), listed(q), F.lit(")a"))).when(F.col(kind) == "C", F.concat(F.lit("("), F.col(p), F.lit(", "), F.col(q)[0], F.lit(")c"))).otherwise(F.concat(F.lit("("), F.col(p), F.lit(", "), listed(q), F.lit(", "), listed(qx), F.lit(")d")))
