"""Makes a random game, writes it as a JSON document, reads it back and solves it: ``python -m examples.solve_game FILE [nodes] [seed]``."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from tracewise.operators.solve import solve
from tracewise.sources import games


def main(spark: SparkSession, path: str, nodes: int = 100, seed: int = 0) -> int:
    spark.createDataFrame([(json.dumps(games.random_game(nodes, seed)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    game = games.from_json(spark, path)
    won = solve(game)
    for row in won.orderBy("pos").collect():
        print(row.pos, row.energies)
    return won.count()


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate(), sys.argv[1], *map(int, sys.argv[2:]))
