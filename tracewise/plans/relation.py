"""An equivalence relation on states as a table that can be asked and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.plans.iterate import HOT, cut, discard


class Relation:
    """``classes`` (pid, class_id): each state with the least state of its class."""

    def __init__(self, classes: DataFrame) -> None:
        self.classes = classes.select("pid", "class_id")

    def find(self, pid: int) -> int:
        row = self.classes.where(F.col("pid") == pid).first()
        if row is None:
            raise IndexError(f"no state {pid}")
        return row.class_id

    def equiv(self, p: int, q: int) -> bool:
        return self.find(p) == self.find(q)

    def __len__(self) -> int:
        """How many states it is over."""
        return self.classes.count()

    def count(self) -> int:
        """How many classes there are."""
        return self.classes.select("class_id").distinct().count()

    def union(self, pairs: DataFrame) -> Relation:
        """The least equivalence that also relates each of ``pairs`` (p, q): classes that pairs link take their least name, by rounds of
        least neighbours and pointer jumps over the linked classes only."""
        own = self.classes
        a = pairs.join(own.select(F.col("pid").alias("p"), F.col("class_id").alias("u")), "p")
        links = a.join(own.select(F.col("pid").alias("q"), F.col("class_id").alias("v")), "q").select("u", "v").where("u <> v")
        links = links.distinct()
        links = cut(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        names = cut(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("name")))
        while True:
            near = links.join(names.select(F.col("u").alias("v"), "name"), "v").groupBy("u").agg(F.min("name").alias("near"))
            best = names.join(near, "u").select("u", F.col("name").alias("old"), F.least("name", "near").alias("name"))
            up = names.select(F.col("u").alias("name"), F.col("name").alias("up"))
            new = cut(best.join(up, "name", "left").select("u", "old", F.least("name", F.coalesce("up", "name")).alias("name")).withColumn("fresh", F.col("old") != F.col("name")), "fresh")
            discard(names)
            names = new
            if not new.rows:
                break
        names = cut(names.select(F.col("u").alias("class_id"), "name"))
        merged = own.join(F.broadcast(names) if names.rows <= HOT else names, "class_id", "left")
        return Relation(cut(merged.select("pid", F.coalesce("name", "class_id").alias("class_id"))))
