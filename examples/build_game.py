"""Prints the comparison game of two machines: ``python -m examples.build_game``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewise.operators.build import show_position
from tracewise.plans.equivalence import LTS
from tracewise.queries import MACHINES
from tracewise.sources import lts


def main(spark: SparkSession) -> list[str]:
    system = LTS(lts.from_edges(spark, MACHINES), sparse=True)
    game = system.game(spark.createDataFrame([(0, 10)], "p bigint, q bigint"))
    shown = game.positions.select("pos", show_position().alias("text"))
    to = shown.select(F.col("pos").alias("dst"), F.col("text").alias("to"))
    lines = [f"{r.text} -> {r.to}" for r in game.moves.join(shown.withColumnRenamed("pos", "src"), "src").join(to, "dst").orderBy("text", "to").collect()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate())
