"""Energies, updates and notions as Column expressions.

An energy is a vector of small numbers, the largest of which means "unbounded". Within plans it is one BIGINT with a guard bit above
each field, so order and supremum are a few integer operations in generated code; configurations too wide for that use arrays.
At the API energies are ARRAY<BIGINT>.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The notions and their vectors in the standard configuration, coarse to fine as the vectors allow.
NOTIONS = {
    "enabledness": (1, 1, 0, 0, 0, 0),
    "traces": (3, 1, 0, 0, 0, 0),
    "failures": (3, 2, 0, 0, 1, 1),
    "failure_traces": (3, 3, 3, 0, 1, 1),
    "readiness": (3, 2, 1, 1, 1, 1),
    "readiness_traces": (3, 3, 3, 1, 1, 1),
    "revivals": (3, 2, 1, 0, 1, 1),
    "impossible_futures": (3, 2, 0, 0, 3, 1),
    "possible_futures": (3, 2, 3, 3, 3, 1),
    "simulation": (3, 3, 3, 3, 0, 0),
    "ready_simulation": (3, 3, 3, 3, 1, 1),
    "nested_2simulation": (3, 3, 3, 3, 3, 1),
    "bisimulation": (3, 3, 3, 3, 3, 3),
}


@dataclass(frozen=True)
class EnergyConf:
    """How many numbers a vector has, and the largest."""

    elements: int
    max: int

    def __post_init__(self) -> None:
        if self.elements < 1 or self.max < 1:
            raise ValueError("a configuration needs at least one element and a positive maximum")

    # sizes of the compact external form

    def energy_bits(self) -> int:
        """Bits of an element: the least power of two that holds ``max``."""
        bits = 1
        while (1 << bits) - 1 < self.max:
            bits *= 2
        return bits

    def energy_size(self) -> int:
        """32-bit words of an energy."""
        return -(-self.elements // (32 // self.energy_bits()))

    def energy_mask(self) -> int:
        return (1 << self.energy_bits()) - 1

    def update_bits(self) -> int:
        """Bits of an update's element: a power of two that holds ``elements + 2``, so none, decrement and all minima are told apart."""
        bits = 1
        while bits < (self.elements + 2).bit_length():
            bits *= 2
        return bits

    def update_mask(self) -> int:
        return (1 << self.update_bits()) - 1

    def update_size(self) -> int:
        return -(-self.elements // (32 // self.update_bits()))

    # plain vectors

    def energy(self, values: list[int]) -> tuple[int, ...]:
        """A whole vector; missing numbers are 0."""
        if len(values) > self.elements:
            raise ValueError(f"{len(values)} values for {self.elements} elements")
        if any(v < 0 or v > self.max for v in values):
            raise ValueError(f"values must be from 0 to {self.max}")
        return (*values, *[0] * (self.elements - len(values)))

    def energies(self, values: list[list[int]]) -> list[tuple[int, ...]]:
        """A checked energy set from whole vectors: at least one, each of exactly as many numbers as the configuration has."""
        if not values:
            raise ValueError("an empty list of energies has no configuration")
        if any(len(v) != self.elements for v in values):
            raise ValueError("energies of different configurations")
        return [self.energy(list(v)) for v in values]

    def update(self, values: list[int]) -> tuple[int, ...]:
        """A whole update: 0 none, -1 decrement, k the minimum with element k (from 1)."""
        if len(values) > self.elements:
            raise ValueError(f"{len(values)} values for {self.elements} elements")
        if any(v < -1 or v > self.elements for v in values):
            raise ValueError(f"updates must be -1, 0 or an element from 1 to {self.elements}")
        return (*values, *[0] * (self.elements - len(values)))


STANDARD = EnergyConf(6, 3)
SILENT_STEP = EnergyConf(8, 2)
ONE_DIMENSION = EnergyConf(1, (1 << 32) - 1)


class Packed:
    """Energies as BIGINT, for configurations of at most 62 bits with guards."""

    type = "bigint"

    def __init__(self, conf: EnergyConf) -> None:
        self.conf = conf
        self.width = conf.max.bit_length() + 1
        if conf.elements * self.width > 62:
            raise ValueError("too wide to pack")
        self.guards = sum(1 << (self.width * (i + 1) - 1) for i in range(conf.elements))
        self.mask = (1 << (self.width - 1)) - 1

    def lit(self, values) -> Column:
        return F.lit(sum(v << (self.width * i) for i, v in enumerate(self.conf.energy(list(values))))).cast("bigint")

    def field(self, e: Column, i: int) -> Column:
        return F.shiftright(e, self.width * i).bitwiseAND(F.lit(self.mask))

    def of_fields(self, fields: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.shiftleft(f.cast("bigint"), self.width * i) for i, f in enumerate(fields)])

    def from_array(self, a: Column) -> Column:
        return self.of_fields([F.coalesce(F.get(a, F.lit(i)), F.lit(0)) for i in range(self.conf.elements)])

    def to_array(self, e: Column) -> Column:
        return F.array(*[self.field(e, i) for i in range(self.conf.elements)])

    def _ahead(self, a: Column, b: Column) -> Column:
        """Guard bits of the fields in which b is at least a."""
        return (b.bitwiseOR(F.lit(self.guards)) - a).bitwiseAND(F.lit(self.guards))

    def le(self, a: Column, b: Column) -> Column:
        return self._ahead(a, b) == F.lit(self.guards)

    def sup(self, a: Column, b: Column) -> Column:
        m = self._ahead(a, b)
        own = m - F.shiftright(m, self.width - 1)
        return b.bitwiseAND(own).bitwiseOR(a.bitwiseAND(F.bitwise_not(own)).bitwiseAND(F.lit(~self.guards)))

    def raised(self, e: Column, dec: Column) -> Column:
        """Both added, up to the maximum."""
        top = sum(self.conf.max << (self.width * i) for i in range(self.conf.elements))

        def of(x: Column) -> Column:
            within = self._ahead(x, F.lit(top))
            own = within - F.shiftright(within, self.width - 1)
            return x.bitwiseAND(own).bitwiseOR(F.bitwise_not(own).bitwiseAND(F.lit(top)))

        return F.when(dec == 0, e).otherwise(F.transform(F.array(e + dec), of)[0])

    def lowered(self, e: Column, i: Column) -> Column:
        """e before a decrement of element i."""
        at = (i * self.width).cast("int")
        field = F.call_function("shiftright", e, at).bitwiseAND(F.lit(self.mask).cast("bigint"))
        return e + F.when(field < self.conf.max, F.call_function("shiftleft", F.lit(1).cast("bigint"), at)).otherwise(F.lit(0).cast("bigint"))

    def joined(self, e: Column, i: Column, k: Column) -> Column:
        """e with element k at least element i."""
        from_, to = (i * self.width).cast("int"), (k * self.width).cast("int")
        field = F.call_function("shiftright", e, from_).bitwiseAND(F.lit(self.mask).cast("bigint"))
        return self.sup(e, F.call_function("shiftleft", field, to))


class Wide:
    """Energies as ARRAY<BIGINT>, for any configuration."""

    type = "array<bigint>"

    def __init__(self, conf: EnergyConf) -> None:
        self.conf = conf

    def lit(self, values) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in self.conf.energy(list(values))])

    def field(self, e: Column, i: int) -> Column:
        return F.get(e, F.lit(i))

    def of_fields(self, fields: list[Column]) -> Column:
        return F.array(*[f.cast("bigint") for f in fields])

    def from_array(self, a: Column) -> Column:
        return self.of_fields([F.coalesce(F.get(a, F.lit(i)), F.lit(0)) for i in range(self.conf.elements)])

    def to_array(self, e: Column) -> Column:
        return e

    def le(self, a: Column, b: Column) -> Column:
        return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda ok: ok)

    def sup(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.greatest(x, y))

    def raised(self, e: Column, dec: Column) -> Column:
        return F.zip_with(e, dec, lambda x, d: F.least(x + d, F.lit(self.conf.max).cast("bigint")))

    def lowered(self, e: Column, i: Column) -> Column:
        return F.transform(e, lambda x, j: F.when(j == i, F.least(x + 1, F.lit(self.conf.max).cast("bigint"))).otherwise(x))

    def joined(self, e: Column, i: Column, k: Column) -> Column:
        return F.transform(e, lambda x, j: F.when(j == k, F.greatest(x, F.get(e, i.cast("int")))).otherwise(x))


def codec(conf: EnergyConf) -> Packed | Wide:
    return Packed(conf) if conf.elements * (conf.max.bit_length() + 1) <= 62 else Wide(conf)


def inverse_update(code: Packed | Wide, e: Column, update: list[int]) -> Column:
    """The least energy from which ``update`` leads to at least ``e``: decrements undone (up to the maximum), then minima in order."""
    conf = code.conf
    u = conf.update(list(update))
    fields = [code.field(e, i) for i in range(conf.elements)]
    fields = [F.least(f + 1, F.lit(conf.max).cast("bigint")) if k == -1 else f for f, k in zip(fields, u, strict=True)]
    for i, k in enumerate(u):
        if k > 0 and k - 1 != i:
            fields[k - 1] = F.greatest(fields[k - 1], fields[i])
    return code.of_fields(fields)


def update_steps(code: Packed | Wide, u: Column) -> Column:
    """An update given as data, an array of whole length, as a struct of two parts: ``dec``, an energy with 1 in each element that is
    decremented, and ``mins``, the minima in order, each as the places of the element and of the one it is the minimum with."""
    n = code.conf.elements
    at = [F.get(u, F.lit(i)) for i in range(n)]
    dec = code.of_fields([F.when(x == -1, 1).otherwise(0).cast("bigint") for x in at])
    mins = [F.when((x > 0) & (x != i + 1), F.lit(i * PLACES) + x.cast("bigint") - 1) for i, x in enumerate(at)]
    return F.struct(dec.alias("dec"), F.filter(F.array(*mins), lambda x: x.isNotNull()).alias("mins"))


#: Places of elements in ``mins`` count up to this.
PLACES = 1 << 20


def steps_in_turn(code: Packed | Wide, updates: list[tuple]) -> Column:
    """``update_steps`` of updates made one after the other, whose inverses are worked from the last to the first. A decrement is written as
    the place of its element twice among the minima."""
    *first, last = [code.conf.update(list(u)) for u in updates]
    places = [i * PLACES + k - 1 for i, k in enumerate(last) if k > 0 and k - 1 != i]
    for u in reversed(first):
        places += [i * PLACES + i for i, k in enumerate(u) if k == -1] + [i * PLACES + k - 1 for i, k in enumerate(u) if k > 0 and k - 1 != i]
    dec = code.of_fields([F.lit(int(k == -1)).cast("bigint") for k in last])
    return F.struct(dec.alias("dec"), F.array(*[F.lit(p).cast("bigint") for p in places]).cast("array<bigint>").alias("mins"))


def inverse_by_steps(code: Packed | Wide, e: Column, dec: Column, mins: Column) -> Column:
    """``inverse_update`` by the parts of ``update_steps``: an expression of one size, however many updates there are."""

    def step(acc: Column, p: Column) -> Column:
        i, k = F.floor(p / PLACES), p % PLACES
        return F.when(i == k, code.lowered(acc, i)).otherwise(code.joined(acc, i, k))

    return F.aggregate(mins, code.raised(e, dec), step)


#: Sets of more energies, or whose sizes have a larger product, are worked as bit maps where the configuration allows.
MANY, PRODUCT = 48, 144


def _maps(code: Packed | Wide):
    from tracewise.functions import upsets

    return upsets.BitMaps(code) if isinstance(code, Packed) and upsets.fits(code.conf) else None


def _minimal(code: Packed | Wide, es: Column) -> Column:
    """By comparing all pairs; ``es`` is bound once."""
    return F.array_sort(F.transform(F.array(F.array_distinct(es)), lambda d: F.filter(d, lambda e: ~F.exists(d, lambda f: (f != e) & code.le(f, e))))[0])


def skyline(code: Packed | Wide, es: Column, large: bool = True) -> Column:
    """The minimal energies of an array, sorted. ``large``: with bit maps for large sets, where the configuration allows them."""
    maps = _maps(code) if large else None
    if maps is None:
        return _minimal(code, es)
    return F.transform(F.array(es), lambda x: F.when(F.size(x) > MANY, maps.minimal(maps.above(x))).otherwise(_minimal(code, x)))[0]


def meet(code: Packed | Wide, a: Column, b: Column, large: bool = True) -> Column:
    """The minimal energies above one of ``a`` and one of ``b``, sorted: minimal suprema."""
    maps = _maps(code) if large else None
    pairs = _minimal(code, F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: code.sup(x, y)))))
    if maps is None:
        return pairs
    both = F.transform(F.array(F.transform(F.array(a, b), maps.above)), lambda m: maps.minimal(maps.both(m[0], m[1])))[0]
    return F.when(F.size(a) * F.size(b) > PRODUCT, both).otherwise(pairs)


def holds(code: Packed | Wide, es: Column, notion) -> Column:
    """Whether no energy is within the notion: then it relates the pair. No energies: every notion holds."""
    return ~F.exists(es, lambda e: code.le(e, code.lit(notion)))


def compare_order(a: Column, b: Column) -> Column:
    """-1, 0, 1 for vectors (arrays) less, equal, greater in all elements; null if incomparable."""
    le = F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda ok: ok)
    ge = F.forall(F.zip_with(a, b, lambda x, y: x >= y), lambda ok: ok)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("energies of different configurations"))).otherwise(F.when(le & ge, 0).when(le, -1).when(ge, 1))


def same_energies(a: Column, b: Column) -> Column:
    """Equality of energy sets given as arrays, in any order."""
    return F.array_sort(a) == F.array_sort(b)


def show_energy(e: Column, conf: EnergyConf = STANDARD) -> Column:
    """Text of a vector (array); the maximum is written as the sign for infinity."""
    return F.concat(F.lit("("), F.concat_ws(", ", F.transform(e, lambda x: F.when(x == conf.max, "∞").otherwise(x.cast("string")))), F.lit(")"))


def show_energies(es: Column, conf: EnergyConf = STANDARD) -> Column:
    return F.concat(F.lit("["), F.concat_ws("\n", F.transform(es, lambda e: show_energy(e, conf))), F.lit("]"))


def show_update(u: Column) -> Column:
    """Text of an update: 0 none, - decrement, m and its element for a minimum."""
    return F.concat(F.lit("("), F.concat_ws(", ", F.transform(u, lambda x: F.when(x == 0, "0").when(x == -1, "-").otherwise(F.concat(F.lit("m"), x.cast("string"))))), F.lit(")"))


def notions(spark: SparkSession) -> DataFrame:
    """(notion, energy) of all notions."""
    return spark.createDataFrame([(k, list(v)) for k, v in NOTIONS.items()], "notion string, energy array<bigint>")


def packed_words(e: Column, conf: EnergyConf) -> Column:
    """The compact external form of a vector (array): 32-bit words, first element in the lowest bits."""
    bits, per = conf.energy_bits(), 32 // conf.energy_bits()
    words = []
    for w in range(conf.energy_size()):
        part = [F.shiftleft(F.get(e, F.lit(i)).cast("bigint"), bits * (i - w * per)) for i in range(w * per, min(conf.elements, (w + 1) * per))]
        words.append(reduce(lambda a, b: a + b, part))
    return F.array(*words)


def unpacked_words(words: Column, conf: EnergyConf) -> Column:
    bits, per = conf.energy_bits(), 32 // conf.energy_bits()
    return F.array(*[F.shiftright(F.get(words, F.lit(i // per)), bits * (i % per)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(conf.elements)])


# energy sets and updates as array columns


def no_energies() -> Column:
    return F.array().cast("array<array<bigint>>")


def zero_energies(n: int, conf: EnergyConf) -> Column:
    """n energies of zeros."""
    one = F.array(*[F.lit(0).cast("bigint")] * conf.elements)
    return F.array_repeat(one, n) if n else no_energies()


def n_energies(es: Column) -> Column:
    return F.size(es).cast("bigint")


def get_energy(es: Column, i: int) -> Column:
    """The i-th energy of a set, from 0; an error beyond its end."""
    return F.when((F.size(es) > i) & F.lit(i >= 0), F.get(es, F.lit(i))).otherwise(F.raise_error(F.lit(f"no energy {i}")).cast("array<bigint>"))


def _checked(e: Column, conf: EnergyConf) -> Column:
    fits = (F.size(e) == conf.elements) & F.forall(e, lambda x: (x >= 0) & (x <= conf.max))
    return F.when(fits, e).otherwise(F.raise_error(F.lit("an energy of another configuration")).cast("array<bigint>"))


def set_energy(es: Column, i: int, e: Column, conf: EnergyConf) -> Column:
    """The set with its i-th energy replaced; an error beyond its end or for an energy of another configuration."""
    inside = (F.size(es) > i) & F.lit(i >= 0)
    made = F.transform(es, lambda x, k: F.when(k == i, _checked(e, conf)).otherwise(x))
    return F.when(inside, made).otherwise(F.raise_error(F.lit(f"no energy {i}")).cast("array<array<bigint>>"))


def packed_update(u: Column, conf: EnergyConf) -> Column:
    """The compact external form of an update (array): 32-bit words, first element in the lowest bits. 0 is none, 1 a decrement, and
    k + 1 the minimum with element k."""
    bits, per = conf.update_bits(), 32 // conf.update_bits()
    code = lambda i: F.when(F.get(u, F.lit(i)) == -1, 1).when(F.get(u, F.lit(i)) > 0, F.get(u, F.lit(i)) + 1).otherwise(0).cast("bigint")
    words = []
    for w in range(conf.update_size()):
        words.append(reduce(lambda a, b: a + b, [F.shiftleft(code(i), bits * (i - w * per)) for i in range(w * per, min(conf.elements, (w + 1) * per))]))
    return F.array(*words)


def unpacked_update(words: Column, conf: EnergyConf) -> Column:
    bits, per = conf.update_bits(), 32 // conf.update_bits()
    out = []
    for i in range(conf.elements):
        x = F.shiftright(F.get(words, F.lit(i // per)), bits * (i % per)).bitwiseAND(F.lit(conf.update_mask()))
        out.append(F.when(x == 1, -1).when(x > 1, x - 1).otherwise(0).cast("int"))
    return F.array(*out)
