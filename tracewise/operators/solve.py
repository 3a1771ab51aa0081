"""Energy games: the least energies with which the attacker wins from each position.

A step works positions anew from their successors. An attacker's energies are the minimal ones among those of its successors, led back
over the moves; a defender's are the minimal suprema of one energy of each successor, once every successor has some. Operators are
monotone on a finite lattice, so steps end in the least fixpoint.

Moves carry their updates as data, so a game may have any number of different ones. Several steps are one plan: a step is one join by
target and one aggregation by source, whose output the next step joins where it lies, and the moves are shuffled once for all steps of
a plan. When few energies changed in a plan, the next one works only the positions that those can reach backwards in its steps, and what it
writes is a table of changes beside the base table; changes are merged into the base when they have grown to a part of it.

Before that, positions that lead to settled ones only are worked once each and settled, as long as a round settles many: a game without cycles takes
no more. Shuffles have as many partitions as the rows ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.energy import MANY, EnergyConf, codec, inverse_by_steps, meet, skyline, steps_in_turn, update_steps
from tracewise.operators.build import Game
from tracewise.plans.iterate import HELD, cut, dealt, discard, union_all

#: Steps of a plan.
STEPS = 6
#: A plan works only what can change if at most one in this many positions changed in the last one. Changes are merged into the base when
#: there is one for this many rows of the base.
FEW, MERGE = 64, 4
#: Sets of more energies bring in the bit maps.
LARGE = 8
#: Successors of a defender that are met in one group; those of defenders with more are met in several groups first.
TOGETHER = 1024


def standard_reach(game: Game) -> DataFrame:
    """(pos): defenders without moves, where the attacker has won."""
    return game.positions.where("NOT is_attack").select("pos").join(game.moves.select(F.col("src").alias("pos")), "pos", "left_anti")


class _Names:
    """Positions as numbers: numbers stay, others are hashed, with another seed if two of them have the same hash."""

    def __init__(self, positions: DataFrame) -> None:
        self.positions, self.seed = positions, 0
        self.plain = positions.schema["pos"].dataType.typeName() in ("long", "integer", "short", "byte")
        while not self.plain:
            same = positions.select("pos").distinct().groupBy(self.number("pos").alias("n")).agg(F.count("*").alias("rows"))
            if not same.where("rows > 1").limit(1).count():
                break
            self.seed += 1

    def number(self, pos: str):
        return F.col(pos).cast("bigint") if self.plain else F.xxhash64(pos, F.lit(self.seed))

    def back(self, rows: DataFrame) -> DataFrame:
        if self.plain:
            return rows.withColumn("pos", F.col("pos").cast(self.positions.schema["pos"].dataType))
        return rows.join(self.positions.select(F.col("pos").alias("name"), self.number("pos").alias("pos")), "pos").drop("pos").withColumnRenamed("name", "pos")


def _prepared(game: Game, names: _Names, won: DataFrame | None) -> DataFrame:
    """(src, dst, is_attack, need, dec, mins), split by ``leaf``: the moves of positions not in ``won`` (pos), and a row, without dst, for each of these
    positions that has none. A position's moves are made distinct, counted and joined with it where they lie."""
    code = codec(game.conf)
    owners = game.positions.select(names.number("pos").alias("src"), "is_attack")
    moves = game.moves.select(names.number("src").alias("src"), names.number("dst").alias("dst"), "upd").where("src IS NOT NULL AND dst IS NOT NULL").repartition("src").distinct()
    if won is not None:
        owners, moves = (rows.join(won.select(F.col("pos").alias("src")), "src", "left_anti") for rows in (owners, moves))
    need = moves.groupBy("src").agg(F.count("*").alias("need"))
    steps = F.when(F.col("dst").isNotNull(), _told_steps(code, game)).alias("s")
    rows = owners.join(need, "src", "left").join(moves, "src", "left").select("src", "dst", "is_attack", "need", steps)
    return cut(rows.select("src", "dst", "is_attack", "need", "s.dec", "s.mins", F.col("dst").isNull().alias("leaf")), "leaf")


def _told_steps(code, game: Game):
    """The steps of the update in ``upd``: of the array itself, or of the number of one or of several."""
    if game.updates is None:
        return update_steps(code, F.col("upd"))
    whole = lambda u: F.array(*map(F.lit, u))
    known = {k: update_steps(code, whole(u)) for k, u in game.updates.items()}
    known |= {k: steps_in_turn(code, [game.updates[i] for i in way]) for k, way in game.ways.items()}
    return F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), s.alias("s")) for k, s in known.items()])), F.col("upd"))


def _stay(code, at: DataFrame) -> DataFrame:
    """A move of each position (pos) to itself, which keeps its energies."""
    none = update_steps(code, F.array(*[F.lit(0)] * code.conf.elements))
    rows = at.select(F.col("pos").alias("src"), F.col("pos").alias("dst"), F.lit(True).alias("is_attack"), F.lit(1).cast("bigint").alias("need"), none.alias("s"))
    return rows.select("src", "dst", "is_attack", "need", "s.dec", "s.mins")


class _Steps:
    """Steps of a game. ``wide``: a defender may have many successors, which are met in groups first. ``large``: sets may be large, so bit maps
    are at hand; without them plans are smaller. Both give the same energies. Expressions are made once and used in each step."""

    def __init__(self, code, wide: bool, large: bool) -> None:
        self.wide, self.large = wide, large
        self.led = F.transform("es", lambda e: inverse_by_steps(code, e, F.col("dec"), F.col("mins"))).alias("es")
        self.part = F.when(F.col("need") > TOGETHER, F.pmod(F.xxhash64("dst"), F.ceil(F.col("need") / TOGETHER))).otherwise(F.lit(0).cast("bigint")).alias("part")
        first = F.array_sort(F.transform("sets", lambda s: F.struct(F.size(s).alias("n"), s.alias("es"))))
        met = F.transform(F.array(first), lambda s: F.aggregate(F.slice(s, 2, F.size(s) - 1), F.get(s, F.lit(0))["es"], lambda acc, x: meet(code, acc, x["es"], large)))[0]
        self.worked = skyline(code, F.when(F.col("is_attack"), F.flatten("sets")).otherwise(met), large).alias("es")
        self.sets, self.one, self.more = F.collect_set("es").alias("sets"), F.count("*").alias("solved"), F.sum("solved").alias("solved")
        self.whole, self.pos, self.to = F.expr("is_attack OR solved = need"), F.col("src").alias("pos"), F.col("pos").alias("dst")
        self.kind = [F.any_value("is_attack").alias("is_attack"), F.any_value("need").alias("need")]
        self.differs = F.col("old").isNull() | (F.col("old") != F.col("es"))

    def once(self, moves: DataFrame, state: DataFrame, held: bool, whole: str | None = None) -> DataFrame:
        """(pos, es) from the energies before, of the positions for which ``whole`` holds. Equal sets of several successors are one: that changes no union and no supremum.

        Groups are by source alone, so that the next step's join finds its rows where they are. ``held``: a partition of the energies, which
        have one row for each position, is small enough to be held as a hash table."""
        to = state.select(self.to, "es")
        joined = moves.join(to.hint("shuffle_hash") if held else to, "dst").select("src", "dst", "is_attack", "need", self.led)
        made = joined.groupBy("src").agg(*self.kind, self.one, self.sets)
        if self.wide:
            part = joined.groupBy("src", self.part).agg(*self.kind, self.one, self.sets).select("src", "is_attack", "need", "solved", self.worked)
            made = part.groupBy("src").agg(*self.kind, self.more, self.sets)
        return made.where(self.whole if whole is None else F.expr(whole)).select(self.pos, self.worked)

    def several(self, moves: DataFrame, state: DataFrame, held: bool) -> DataFrame:
        """(pos, es, fresh): the energies after STEPS steps, and whether the last step changed them."""
        moves = moves.where("src IS NOT NULL AND dst IS NOT NULL")  # said in each step, so that all read the same shuffled moves
        after = state
        for _ in range(STEPS):
            before, after = after, self.once(moves, after, held)
        return self._told(after, before, "fresh", held)

    def _told(self, after: DataFrame, before: DataFrame, name: str, held: bool) -> DataFrame:
        old = before.select("pos", F.col("es").alias("old"))
        return after.join(old.hint("shuffle_hash") if held else old, "pos", "left").withColumn(name, self.differs).drop("old")

    def changed(self, moves: DataFrame, state: DataFrame, held: bool) -> DataFrame:
        """``several``, of the positions whose energies differ from those of ``state``."""
        return self._told(self.several(moves, state, held), state, "changed", held).where("changed").select("pos", "es", "fresh")


class _State:
    """Energies (pos, es): a base table, and a table of changes that hold instead."""

    def __init__(self, base: DataFrame, size: int) -> None:
        self.base, self.changes, self.size = base, None, size

    def tables(self) -> list[DataFrame]:
        return [t for t in (self.base, self.changes) if t is not None]

    def now(self) -> DataFrame:
        base = self.base.select("pos", "es")
        if self.changes is None:
            return base
        changes = self.changes.select("pos", "es")
        return base.join(changes.select("pos"), "pos", "left_anti").unionByName(changes)

    def change(self, made: DataFrame) -> _State:
        """With the changes ``made``: what earlier changes remain is written with them, and the base with all of them only at intervals."""
        new = self.changes.join(made.select("pos"), "pos", "left_anti").select("pos", "es").unionByName(made.select("pos", "es")) if self.changes is not None else made.select("pos", "es")
        new = cut(new)
        after = _State(self.base, self.size)
        after.changes = new
        if self.changes is not None:
            discard(self.changes)
        if new.rows * MERGE > self.size:
            base = cut(after.now())
            discard(self.base, new)
            return _State(base, base.rows)
        return after


def _reached(moves: DataFrame, fresh: DataFrame) -> DataFrame:
    """(pos): what has a way of at most STEPS moves to a position of ``fresh``."""
    found, last = None, fresh.select("pos")
    for _ in range(STEPS):
        last = moves.join(last.select(F.col("pos").alias("dst")), "dst", "left_semi").where("src <> dst").select(F.col("src").alias("pos")).distinct()
        found = last if found is None else found.unionByName(last)
    return cut(found.distinct())


def _settled(moves: DataFrame, ends: DataFrame, steps: _Steps, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """The moves of positions that remain, and tables (pos, es) of those that are settled, with none for those that can't be won.

    ``ends`` are settled. A position that leads to settled ones only is worked once and is settled too, and its moves are not read again. This ends
    when a round settles less than one position for FEW moves."""
    done = [ends]
    while moves.rows:
        with dealt(moves.sparkSession, moves.rows + sum(t.rows for t in done)):
            new = cut(steps.once(moves, union_all(done), max(t.rows for t in done) <= HELD * parts, "solved = need"))
            if new.rows * FEW < moves.rows:
                discard(new)
                break
            rest = cut(moves.join(new.select(F.col("pos").alias("src")), "src", "left_anti"))
        if hasattr(moves, "cut_path"):
            discard(moves)
        moves = rest
        done.append(new)
    return moves, done


def solve(game: Game, reach: DataFrame | None = None) -> DataFrame:
    """(pos, energies: array of vectors) of all positions with any; ``reach`` (pos) are the positions won from the start."""
    spark = game.moves.sparkSession
    code = codec(game.conf)
    names = _Names(game.positions)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    won = None if reach is None else cut(reach.select("pos").distinct().select(names.number("pos").alias("pos")))
    with dealt(spark, game.rows or 0):
        rows = _prepared(game, names, won)
    leaves, moves = rows.where("leaf"), rows.where("NOT leaf").drop("leaf")
    moves.rows = rows.all_rows - rows.rows
    most = moves.agg(F.max(F.when(~F.col("is_attack"), F.col("need"))), F.max("need")).first()
    steps = _Steps(code, (most[0] or 0) > TOGETHER, (most[1] or 0) > MANY)
    zero, none = F.array(code.lit([])), F.array().cast(f"array<{code.type}>")
    ends = leaves.select(F.col("src").alias("pos"), (none if reach is not None else F.when(F.col("is_attack"), none).otherwise(zero)).alias("es"))
    ends.rows = rows.rows
    if won is not None:
        ends = ends.unionByName(won.select("pos", zero.alias("es")))
        ends.rows = rows.rows + won.rows
    moves, done = _settled(moves, ends, steps, parts)
    settled = union_all(done).where(F.size("es") > 0)
    out = settled
    if moves.rows:
        with dealt(spark, moves.rows + sum(t.rows for t in done)):
            near = cut(settled.join(moves.select(F.col("dst").alias("pos")), "pos", "left_semi").withColumn("fresh", F.lit(True)))
        state = _fixpoint(code, cut(moves.unionByName(_stay(code, near))), near, steps, parts)
        out = state.unionByName(settled.join(state.select("pos"), "pos", "left_anti"))
    return names.back(out.select("pos", F.transform("es", code.to_array).alias("energies"))).select("pos", "energies")


def _fixpoint(code, moves: DataFrame, won: DataFrame, steps: _Steps, parts: int) -> DataFrame:
    """(pos, es) of all positions with any, from those in ``won``, by steps until none changes."""
    spark = moves.sparkSession
    held = lambda rows: rows <= HELD * parts
    game_size = moves.rows  # every position with energies has a move
    state, fresh, many = _State(won, won.rows), won, won.rows
    while many:
        if many * FEW > state.size:
            with dealt(spark, game_size):
                after = cut(steps.several(moves, state.now(), held(game_size)), "fresh")
            discard(*state.tables())
            state, many = _State(after, after.all_rows), after.rows
            fresh = after.where("fresh")
        else:
            active = _reached(moves, fresh)
            own = cut(moves.join(active.select(F.col("pos").alias("src")), "src", "left_semi"))
            around = own.select(F.col("dst").alias("pos")).unionByName(active.select("pos")).distinct()
            begin = cut(state.now().join(around, "pos", "left_semi"))
            frame = begin.select("pos").join(active, "pos", "left_anti")
            made = cut(steps.changed(own.unionByName(_stay(code, frame)), begin, held(begin.rows)), "fresh")
            discard(active, own, begin)
            state, many = state.change(made), made.rows
            fresh = cut(made.where("fresh").select("pos", "es"))
            discard(made)
        if not steps.large and many and fresh.agg(F.max(F.size("es"))).first()[0] > LARGE:
            steps = _Steps(code, steps.wide, True)
    discard(moves)
    return state.now()


def from_edges(spark, edges: list[tuple], attackers: list[int], n: int, conf: EnergyConf) -> Game:
    """A hand-made game of positions 0 to n - 1: edges (src, dst, update), positions owned by the attacker."""
    for src, dst, _ in edges:
        if not (0 <= src < n and 0 <= dst < n):
            raise ValueError(f"an edge from {src} to {dst} in a game of {n} positions")
    moves = spark.createDataFrame([(src, dst, list(conf.update(list(u)))) for src, dst, u in edges], "src bigint, dst bigint, upd array<int>")
    owner = F.col("pos").isin([int(a) for a in attackers]) if attackers else F.lit(False)
    positions = spark.range(n).select(F.col("id").alias("pos")).withColumn("is_attack", owner)
    return Game(positions, moves, None, conf)


def empty_game(spark, conf: EnergyConf) -> Game:
    return from_edges(spark, [], [], 0, conf)


def from_tables(positions: DataFrame, moves: DataFrame, conf: EnergyConf) -> Game:
    """A game from tables (pos, is_attack) and (src, dst, upd: array of ints, missing ones 0), with any number of different updates."""
    upd = F.col("upd").cast("array<int>")
    good = (F.size(upd) <= conf.elements) & F.forall(upd, lambda k: (k >= -1) & (k <= conf.elements))
    told = moves.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad")).first()
    if told.bad:
        raise ValueError(f"updates must have at most {conf.elements} numbers, each -1, 0 or an element from 1 to {conf.elements}")
    padded = F.concat(upd, F.array_repeat(F.lit(0), conf.elements - F.size(upd)))
    game = Game(positions, moves.select("src", "dst", padded.alias("upd")), None, conf)
    game.rows = told.rows
    return game
