"""Energy sets as bit maps, for configurations of at most 4096 vectors whose largest number is one less than a power of two.

A set of energies stands for all energies above one of them. As a bit map of all vectors of the configuration, in 64-bit words, a union of
two sets is OR, what is above both is AND, and the minimal energies are the bits that no smaller neighbour has. The cost of each is that
of the map, whatever the sizes of the sets, where products of sets grow with both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewise.functions.energy import EnergyConf, Packed

CELLS = 4096


def fits(conf: EnergyConf) -> bool:
    return conf.max & (conf.max + 1) == 0 and (conf.max + 1) ** conf.elements <= CELLS


class BitMaps:
    """Maps of packed energies: ARRAY<BIGINT> of words, the first elements in the lowest bits."""

    def __init__(self, code: Packed) -> None:
        self.code, self.conf = code, code.conf
        self.bits = self.conf.max.bit_length()
        self.words = max(1, (self.conf.max + 1) ** self.conf.elements // 64)
        size = min(64, (self.conf.max + 1) ** self.conf.elements)
        steps = [1 << (self.bits * i) for i in range(self.conf.elements)]
        #: Of elements within a word: how far a smaller neighbour is, and the bits that have one. Of others: the same in words.
        self.inner = [(s, sum(1 << b for b in range(size) if b // s & self.conf.max)) for s in steps if s < 64]
        self.inner = [(s, m - (1 << 64) if m >> 63 else m) for s, m in self.inner]
        self.outer = [s // 64 for s in steps if s >= 64]

    def _cell(self, e: Column) -> Column:
        return sum((F.shiftleft(self.code.field(e, i), self.bits * i) for i in range(self.conf.elements)), F.lit(0).cast("bigint"))

    def _energy(self, cell: Column) -> Column:
        return self.code.of_fields([F.shiftright(cell, self.bits * i).bitwiseAND(F.lit(self.conf.max)) for i in range(self.conf.elements)])

    def _near(self, v: Column, k: Column) -> Column:
        """Bits of the word v whose neighbour in the k-th inner element is in it."""
        shift, mask = (F.array(*[F.lit(o[j]).cast(t) for o in self.inner]) for j, t in ((0, "int"), (1, "bigint")))
        return F.call_function("shiftleft", v, F.get(shift, k)).bitwiseAND(F.get(mask, k))

    def _far(self, m: Column, w: Column, k: Column) -> Column:
        """Bits of word number w whose neighbour in the k-th outer element is in the map m."""
        apart = F.get(F.array(*[F.lit(a) for a in self.outer]), k)
        return F.when(F.floor(w / apart) % (self.conf.max + 1) > 0, F.get(m, w - apart)).otherwise(F.lit(0).cast("bigint"))

    @staticmethod
    def _upto(n: int, times: int = 1) -> Column:
        return F.array(*[F.lit(k) for k in range(n) for _ in range(times)])

    def _words(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.words - 1))

    def above(self, es: Column) -> Column:
        """The map of all energies above one of ``es``."""
        zero = F.lit(0).cast("bigint")
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(F.lit(63)).cast("int"))
        cells = F.transform(es, self._cell)
        points = F.transform(F.array(cells), lambda c: F.transform(self._words(), lambda w: F.aggregate(c, zero, lambda a, x: F.when(F.shiftright(x, 6) == w, a.bitwiseOR(bit(x))).otherwise(a))))[0]

        if self.inner:
            points = F.aggregate(self._upto(len(self.inner), self.conf.max), points, lambda m, k: F.transform(m, lambda v: v.bitwiseOR(self._near(v, k))))
        if self.outer:
            points = F.aggregate(self._upto(len(self.outer), self.conf.max), points, lambda m, k: F.transform(m, lambda v, w: v.bitwiseOR(self._far(m, w, k))))
        return points

    def both(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))

    def either(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))

    def minimal(self, m: Column) -> Column:
        """The minimal energies of a map."""

        def bare(x: Column) -> Column:
            def least(v: Column, w: Column) -> Column:
                if self.outer:
                    v = F.aggregate(self._upto(len(self.outer)), v, lambda a, k: a.bitwiseAND(F.bitwise_not(self._far(x, w, k))))
                return v.bitwiseAND(F.bitwise_not(F.aggregate(self._upto(len(self.inner)), F.lit(0).cast("bigint"), lambda a, k: a.bitwiseOR(self._near(F.get(x, w), k)))))

            return F.transform(x, least)

        some = F.transform(F.array(m), bare)[0]
        has = lambda v, b: F.call_function("shiftright", v, b).bitwiseAND(F.lit(1)) == 1
        cells = F.transform(some, lambda v, w: F.when(v == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: has(v, b)), lambda b: self._energy((w * 64 + b).cast("bigint")))))
        return F.array_sort(F.flatten(cells))
