"""Report on a system in a text file: ``python -m tracewise FILE``. Sizes of its game, and how many classes four notions make."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewise.plans.equivalence import LTS
from tracewise.queries import COUNTED
from tracewise.sources.lts import from_text


def main(path: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    edges, _ = from_text(spark, path)
    system = LTS(edges)
    solved = system.equivalences()
    print(f"states {system.n_vertices()}, classes {solved.part.select('cls').distinct().count()}")
    print(f"starts {solved.pairs.count()}, positions {solved.game.n_vertices()}, moves {solved.game.moves.count()}")
    for row in solved.report().where(F.col("notion").isin(COUNTED)).collect():
        print(f"{row.notion}: {row.classes} classes")


if __name__ == "__main__":
    if len(sys.argv) != 2:
        sys.exit(__doc__)
    main(sys.argv[1])
