"""Compares all states of two machines and prints the classes of some notions: ``python -m examples.compare_all``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracewise.plans.equivalence import LTS
from tracewise.queries import COUNTED, MACHINES
from tracewise.sources import lts


def main(spark: SparkSession) -> dict[str, int]:
    solved = LTS(lts.from_edges(spark, MACHINES), sparse=True).equivalences()
    counts = {}
    for notion in COUNTED:
        relation = solved.union_find(notion)
        counts[notion] = relation.count()
        print(f"{notion}: {counts[notion]} classes of {len(relation)} states; 0 and 10 {'are' if relation.equiv(0, 10) else 'are not'} in one")
    return counts


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate())
