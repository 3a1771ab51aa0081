"""Comparing the states of a labeled transition system by all notions of the spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.energy import NOTIONS, STANDARD
from tracewise.operators import build, refine, solve
from tracewise.plans.iterate import HOT, cut, skew_join
from tracewise.plans.relation import Relation
from tracewise.sources.lts import mentioned, universe


def notion_vector(notion) -> tuple:
    """A notion by name, or any vector of the standard configuration."""
    if isinstance(notion, str):
        if notion not in NOTIONS:
            raise ValueError(f"no notion {notion!r}")
        return NOTIONS[notion]
    return STANDARD.energy(list(notion))


def _within(energies: str, vector: tuple):
    """Whether any energy (array) is within the vector."""
    return F.exists(energies, lambda e: F.forall(F.zip_with(e, F.array(*[F.lit(v).cast("bigint") for v in vector]), lambda x, y: x <= y), lambda ok: ok))


def _no_energies():
    return F.array().cast("array<array<bigint>>")


class LTS:
    """An LTS of ``edges`` (src, dst, label of any type that sorts). Its states are 0 to the largest one mentioned, or ``states`` (pid)."""

    def __init__(self, edges: DataFrame, states: DataFrame | None = None, sparse: bool = False) -> None:
        self.edges = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "label")
        self.mentioned = states is None and sparse
        self.states = states.select("pid") if states is not None else mentioned(self.edges) if sparse else universe(self.edges)

    def n_vertices(self) -> int:
        return self.states.count()

    def adj(self, pid: int) -> DataFrame:
        self._check(pid)
        return self.edges.where(F.col("src") == pid).select("label", "dst")

    def _check(self, *pids: int) -> None:
        known = {r.pid for r in self.states.where(F.col("pid").isin(list(pids))).collect()}
        for p in pids:
            if p not in known:
                raise IndexError(f"no state {p}")

    def minimize(self) -> tuple[LTS, DataFrame]:
        """The quotient by strong bisimilarity, on each class's least state, and the classes (pid, cls)."""
        part = refine.refine(self.edges, None if self.mentioned else self.states)
        small = cut(refine.quotient(self.edges, part))
        return LTS(small, part.select(F.col("cls").alias("pid")).distinct()), part

    def game(self, pairs: DataFrame, max_positions: int | None = None) -> build.Game:
        return build.build(self.edges, self.states, pairs, max_positions)

    def compare_unminimized(self, p: int, q: int) -> DataFrame:
        """(energy) of the position that compares p with q."""
        self._check(p, q)
        pairs = self.edges.sparkSession.createDataFrame([(p, q)], "p bigint, q bigint")
        game = self.game(pairs)
        won = solve.solve(game.lean)
        return won.join(build.seeds(pairs, game.lean.seed).select("pos"), "pos", "left_semi").select(F.explode("energies").alias("energy"))

    def compare(self, p: int, q: int) -> DataFrame:
        """(energy): the least energies that tell p from q; none if they are bisimilar."""
        self._check(p, q)
        small, part = self.minimize()
        cls = {r.pid: r.cls for r in part.where(F.col("pid").isin([p, q])).collect()}
        if cls[p] == cls[q]:
            return self.edges.sparkSession.createDataFrame([], "energy array<bigint>")
        return small.compare_unminimized(cls[p], cls[q])

    def verdicts(self, p: int, q: int) -> DataFrame:
        """(notion, holds): which notions order p below q."""
        energies = self.compare(p, q).agg(F.collect_list("energy").alias("es"))
        return _verdicts(energies.select(F.coalesce("es", _no_energies()).alias("es")), []).select("notion", "holds")

    def verdicts_of(self, pairs: DataFrame) -> DataFrame:
        """(p, q, notion, holds): for each of ``pairs`` (p, q), also of different enabled labels, which notions order p below q.

        All pairs are compared in one game on the quotient, where pairs of the same classes are one."""
        pairs = cut(pairs.select(F.col("p").cast("bigint").alias("p"), F.col("q").cast("bigint").alias("q")).distinct())
        small, part = self.minimize()
        own = lambda name, to: part.select(F.col("pid").alias(name), F.col("cls").alias(to))
        mapped = cut(pairs.join(own("p", "a"), "p", "left").join(own("q", "b"), "q", "left"))
        lost = mapped.where("a IS NULL OR b IS NULL").select(F.when(F.col("a").isNull(), F.col("p")).otherwise(F.col("q")).alias("pid")).first()
        if lost is not None:
            raise IndexError(f"no state {lost.pid}")
        asked = cut(mapped.where("a <> b").select(F.col("a").alias("p"), F.col("b").alias("q")).distinct())
        if not asked.rows:
            return mapped.select("p", "q", F.explode(_told(_no_energies())).alias("v")).select("p", "q", "v.notion", "v.holds")
        game = small.game(asked)
        won = solve.solve(game.lean)
        at = asked.select(F.col("p").alias("a"), F.col("q").alias("b"), build.attack(F.col("p"), F.array("q"), game.lean.seed)["pos"].alias("pos"))
        told = cut(at.join(won, "pos").select("a", "b", _told(F.col("energies")).alias("told")))  # by classes, of which pairs have far fewer
        mapped = mapped.join(F.broadcast(told) if told.rows <= HOT else told, ["a", "b"], "left")
        return mapped.select("p", "q", F.explode(F.coalesce("told", _told(_no_energies()))).alias("v")).select("p", "q", "v.notion", "v.holds")

    def equivalences(self, subset: DataFrame | None = None, max_positions: int | None = None) -> Equivalence:
        """All pairs, solved on the quotient."""
        small, part = self.minimize()
        if subset is not None:
            subset = part.join(subset.select("pid"), "pid", "left_semi").select(F.col("cls").alias("pid")).distinct()
        return small._equivalences(part, subset, max_positions)

    def equivalences_unminimized(self, subset: DataFrame | None = None, max_positions: int | None = None) -> Equivalence:
        return self._equivalences(self.states.select("pid", F.col("pid").alias("cls")), subset, max_positions)

    def _equivalences(self, part: DataFrame, subset: DataFrame | None, max_positions: int | None) -> Equivalence:
        pairs = cut(build.start_pairs(self.edges, self.states, subset, max_positions))
        game = self.game(pairs, max_positions)
        won = solve.solve(game.lean)
        at = pairs.select("p", "q", build.attack(F.col("p"), F.array("q"), game.lean.seed)["pos"].alias("pos"))
        pairs = cut(at.join(won, "pos", "left").select("p", "q", F.coalesce("energies", _no_energies()).alias("energies")))
        return Equivalence(pairs, part, game, self, subset)


def _told(es):
    """An array (notion, holds) of all notions."""
    return F.array(*[F.struct(F.lit(n).alias("notion"), (~_within(es, v)).alias("holds")) for n, v in NOTIONS.items()])


def _verdicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each notion of rows with es."""
    return rows.select(*keys, F.explode(_told("es")).alias("v")).select(*keys, "v.notion", "v.holds")


class Equivalence:
    """Solved comparisons of all pairs of classes with equal enabled labels: ``pairs`` (p, q, energies) and ``part`` (pid, cls).

    Pairs of different enabled labels aren't compared: no equivalence relates them. A preorder may order them one way, which ``below`` finds in a game
    of its own on ``system``, whose states ``subset`` (pid) are compared."""

    def __init__(self, pairs: DataFrame, part: DataFrame, game: build.Game | None, system: LTS | None = None, subset: DataFrame | None = None) -> None:
        self.pairs, self.part, self.game, self.system, self.subset = pairs, part, game, system, subset
        self._sizes: DataFrame | None = None

    def _of_part(self) -> DataFrame:
        """(cls, first, rows): the least state and the number of states that each class stands for."""
        if self._sizes is None:
            self._sizes = cut(self.part.groupBy("cls").agg(F.min("pid").alias("first"), F.count("*").alias("rows")))
        return self._sizes

    @classmethod
    def bind(cls, pairs: DataFrame, energies: DataFrame, part: DataFrame | None = None) -> Equivalence:
        """From given results: ``energies`` (p, q, energies) must have a row for each of ``pairs`` (p, q), which must hold both ways round
        of each pair. Rows for other pairs are left out. ``part`` (pid, cls) says which states the compared ones stand for, by
        default only themselves."""
        if pairs.join(energies, ["p", "q"], "left_anti").limit(1).count():
            raise ValueError("too few energies: a pair has none")
        if pairs.select("p", "q").join(pairs.select(F.col("q").alias("p"), F.col("p").alias("q")), ["p", "q"], "left_anti").limit(1).count():
            raise ValueError("a pair is compared one way round only")
        bound = energies.join(pairs.select("p", "q").distinct(), ["p", "q"], "left_semi")
        if part is None:
            part = pairs.select(F.col("p").alias("pid"), F.col("p").alias("cls")).distinct()
        return cls(bound, part, None)

    def set_minimization(self, part: DataFrame) -> Equivalence:
        """The same comparisons, read through another map (pid, cls) of states to compared ones."""
        return Equivalence(self.pairs, part, self.game, self.system, self.subset)

    def mapped(self, pid: int) -> int:
        row = self.part.where(F.col("pid") == pid).first()
        if row is None:
            raise IndexError(f"no state {pid}")
        return row.cls

    def energies(self, p: int, q: int) -> list | None:
        """Energies of a compared pair; None for one that was not compared (also bisimilar states)."""
        row = self.pairs.where((F.col("p") == self.mapped(p)) & (F.col("q") == self.mapped(q))).first()
        return None if row is None else row.energies

    def preorder(self, p: int, q: int, notion) -> bool:
        a, b = self.mapped(p), self.mapped(q)
        if a == b:
            return True
        row = self.pairs.where((F.col("p") == a) & (F.col("q") == b)).select((~_within("energies", notion_vector(notion))).alias("holds")).first()
        return bool(row and row.holds)

    def equiv(self, p: int, q: int, notion) -> bool:
        return self.preorder(p, q, notion) and self.preorder(q, p, notion)

    def preorders(self, notion) -> DataFrame:
        """(p, q): all ordered pairs of different classes that the notion orders."""
        return self.pairs.where(~_within("energies", notion_vector(notion))).select("p", "q")

    def below(self, notion) -> DataFrame:
        """(p, q): all ordered pairs of different classes that the notion orders, also those of different enabled labels.

        Every notion tells p from q by a label that p has and q has not, so that only q of more labels are compared beside ``pairs``."""
        if self.system is None:
            raise ValueError("results given from outside tell nothing of pairs of different enabled labels")
        asked = cut(build.wider_pairs(self.system.edges, self.system.states, self.subset))
        if not asked.rows:
            return self.preorders(notion)
        game = self.system.game(asked).lean
        at = asked.select("p", "q", build.attack(F.col("p"), F.array("q"), game.seed)["pos"].alias("pos"))
        wider = at.join(solve.solve(game), "pos", "left").withColumn("energies", F.coalesce("energies", _no_energies()))
        return self.preorders(notion).unionByName(wider.where(~_within("energies", notion_vector(notion))).select("p", "q"))

    def equivalents(self, notion) -> DataFrame:
        """(p, q): all pairs of different classes ordered both ways. Every pair was compared both ways round."""
        below = self.preorders(notion)
        return below.join(below.select(F.col("p").alias("q"), F.col("q").alias("p")), ["p", "q"], "left_semi")

    def relation(self, notion) -> DataFrame:
        """(pid, class_id): the equivalence of the notion on all states; a class is called by its least state.

        Both-way order is transitive, so the least partner of a class is that of its whole group."""
        groups, sizes = self._groups(notion), self._of_part()
        total = sizes.agg(F.sum("rows")).first()[0] or 0
        hot = sizes.where(F.col("rows") > max(1000, total // HOT)).select("cls")
        return skew_join(self.part, groups.select("cls", "class_id"), "cls", hot).select("pid", "class_id")

    def _groups(self, notion) -> DataFrame:
        """(cls, rows, class_id): the relation on compared classes, called by the least of the states they stand for."""
        least = self.equivalents(notion).groupBy(F.col("p").alias("cls")).agg(F.min("q").alias("q"))
        groups = self._of_part().join(least, "cls", "left").withColumn("g", F.least("cls", F.coalesce("q", "cls")))
        names = groups.groupBy("g").agg(F.min("first").alias("class_id"))
        return cut(groups.join(names, "g").select("cls", "rows", "class_id"))

    def classes(self, notion) -> DataFrame:
        """(class_id, size): the classes; their members are the rows of ``relation``."""
        return self._groups(notion).groupBy("class_id").agg(F.sum("rows").alias("size"))

    def union_find(self, notion) -> Relation:
        """The equivalence as a relation that can be asked and merged."""
        return Relation(self.relation(notion))

    def count_classes(self, notion) -> int:
        return self._groups(notion).select("class_id").distinct().count()

    def class_of(self, pid: int, notion) -> DataFrame:
        """(pid): the states equivalent to one."""
        rel = cut(self.relation(notion))
        return rel.join(rel.where(F.col("pid") == pid).select("class_id"), "class_id").select("pid")

    def report(self) -> DataFrame:
        """(notion, classes): how many classes each notion makes of all states, in one pass over the pairs."""
        below = cut(_verdicts(self.pairs.select("p", "q", F.col("energies").alias("es")), ["p", "q"]).where("holds").select("notion", "p", "q"))
        both = below.join(below.select("notion", F.col("p").alias("q"), F.col("q").alias("p")), ["notion", "p", "q"], "left_semi")
        least = both.groupBy("notion", F.col("p").alias("cls")).agg(F.min("q").alias("q"))
        spark = below.sparkSession
        every = self._of_part().select("cls").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in NOTIONS], "notion string")))
        groups = every.join(least, ["notion", "cls"], "left").select("notion", F.least("cls", F.coalesce("q", "cls")).alias("g"))
        return groups.groupBy("notion").agg(F.countDistinct("g").alias("classes"))
