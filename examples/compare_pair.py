"""Tells which notions order one machine below the other: ``python -m examples.compare_pair``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracewise.plans.equivalence import LTS
from tracewise.queries import MACHINES
from tracewise.sources import lts


def main(spark: SparkSession) -> dict[str, bool]:
    system = LTS(lts.from_edges(spark, MACHINES), sparse=True)
    found = {r.notion: r.holds for r in system.verdicts(0, 10).collect()}
    for notion, holds in found.items():
        print(f"{notion}: {'ordered' if holds else 'told apart'}")
    return found


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate())
