"""Sources and sinks of labeled transition systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.plans.iterate import cut, followed, ranked

EDGES = "src bigint, dst bigint, label int"
STEP_JSON = "process bigint, label int"


class MissingFieldError(ValueError):
    """A line has fewer than three fields."""


class ParseError(ValueError):
    """A state is not an unsigned number."""


#: The largest state of a text by default, and the largest of an edge table.
MOST, LARGEST = (1 << 32) - 1, (1 << 63) - 1


def _parsed(lines: DataFrame, most: int) -> DataFrame:
    """line, src, dst, name; src and dst null where they aren't unsigned numbers of at most ``most``, name null where it is missing."""
    part = F.split("value", ",", 3)
    digits = len(str(most))

    def number(i: int) -> Column:
        text = F.get(part, F.lit(i))
        n = F.when(text.rlike(rf"^\+?[0-9]{{1,{digits}}}$"), text.try_cast("bigint"))
        return F.when(n <= most, n)

    raw = F.get(part, F.lit(2))
    name = F.when(raw.rlike(r'(?s)^".*"$') & (F.length(raw) >= 2), F.substring(raw, 2, F.length(raw) - 2)).otherwise(raw)
    return lines.select("line", "value", F.size(part).alias("fields"), number(0).alias("src"), number(1).alias("dst"), name.alias("name"))


def from_lines(lines: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of lines (line, value): ``src,dst,label``, where a label keeps further commas and loses one pair of quotes. States are
    numbers of at most ``most``.

    Label ``i`` has number 0, the others 1, 2, .. by first occurrence. Raises for the first bad line; ``line`` counts from 0 and is named
    from 1."""
    rows = cut(_parsed(lines, most))
    bad = rows.where("fields < 3 OR src IS NULL OR dst IS NULL").orderBy("line").select("line", "value", "fields", "src", "dst").first()
    if bad is not None:
        numbers = bad.src is not None and (bad.fields < 2 or bad.dst is not None)
        error = MissingFieldError if bad.fields < 3 and numbers else ParseError
        raise error(f"line {bad.line + 1}: {bad.value!r}")
    first = rows.groupBy("name").agg(F.min("line").alias("line")).where("name <> 'i'")
    labels = cut(ranked(first, "line", "label").select("name", (F.col("label") + 1).cast("int").alias("label")))
    labels = labels.unionByName(lines.sparkSession.createDataFrame([("i", 0)], "name string, label int"))
    return rows.join(labels, "name").select("src", "dst", "label"), labels


def from_text(spark: SparkSession, path: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of text files, read in any number of splits; lines count through the files in the order of their names.

    Rows of a split are consecutive in their task, so a line's number is its place in the split and the lines of the splits before."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    text = cut(spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("id")))
    splits = text.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return from_lines(text.join(splits, ["file", "start"]).select("value", (F.col("id") + F.col("shift")).alias("line")), most)


def from_edges(spark: SparkSession, edges: list[tuple]) -> DataFrame:
    """Edges (src, dst, label) in any order."""
    return spark.createDataFrame([tuple(e) for e in edges], EDGES)


def from_adjacency(spark: SparkSession, adj: list[list[tuple]]) -> DataFrame:
    """Edges of adjacency lists of (target, label)."""
    return from_edges(spark, [(src, dst, label) for src, row in enumerate(adj) for dst, label in row])


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a JSON document ``{"adj": [[{"process": .., "label": ..}, ..], ..]}``, one file or a folder of the pieces of one.

    The document is cut after each object and read in any number of splits, so a state's list may lie in several of them. An edge's state is the
    number of lists that were opened before it, in its split and in the splits before. Objects without a process are no edges."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    opened = F.length("value") - F.length(F.replace("value", F.lit("["), F.lit("")))
    pieces = cut(spark.read.text(path, lineSep="}").select("value", opened.alias("opened"), *meta, F.monotonically_increasing_id().alias("id")))
    before = F.sum("lists").over(Window.orderBy(F.length("file"), "file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = pieces.groupBy("file", "start").agg(F.sum("opened").alias("lists")).select("file", "start", F.coalesce(before, F.lit(0)).alias("lists_before"))
    within = F.sum("opened").over(Window.partitionBy("file", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = pieces.withColumn("lists", within).join(splits, ["file", "start"]).where(F.contains("value", F.lit("{")))
    step = F.from_json(F.concat(F.lit("{"), F.substring_index("value", "{", -1), F.lit("}")), STEP_JSON)
    rows = rows.select((F.col("lists_before") + F.col("lists") - 2).alias("src"), step.alias("t"))  # the outer list, and states count from 0
    return rows.where("t.process IS NOT NULL").select("src", F.col("t.process").alias("dst"), "t.label")


def write_json(edges: DataFrame, path: str, n: int | None = None) -> None:
    """Writes an LTS of the states 0 to ``n`` - 1 (by default, to the largest one mentioned), each row sorted by label, as one JSON document in
    pieces: the part files of the folder, one after the other in the order of their names, are the document.

    A line is an edge or the beginning of a state's list, and the line after it tells what must follow, so no list is ever held whole."""
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first().m
    least = 0 if top is None else top + 1
    if n is not None and n < least:
        raise ValueError(f"state {top} in a system of {n} states")
    spark = edges.sparkSession
    row = lambda pid, kind, text, label=None, dst=None: [pid.cast("bigint").alias("pid"), F.lit(kind).alias("kind"), F.lit(label).cast("int").alias("label") if label is None else label, F.lit(dst).cast("bigint").alias("dst") if dst is None else dst, text.alias("text")]
    step = F.to_json(F.struct(F.col("dst").cast("bigint").alias("process"), F.col("label").cast("int").alias("label")))
    lines = spark.range(least if n is None else n).select(*row(F.col("id"), 1, F.lit("[")))
    lines = lines.unionByName(edges.select(*row(F.col("src"), 2, step, F.col("label").cast("int").alias("label"), F.col("dst").cast("bigint").alias("dst"))))
    ends = spark.range(1)
    lines = lines.unionByName(ends.select(*row(F.lit(-1), 0, F.lit('{"adj":[')))).unionByName(ends.select(*row(F.lit(2**63 - 1), 3, F.lit("]}"))))
    order = ["pid", "kind", "label", "dst"]
    after = F.col("after.kind")
    then = F.when(~F.col("kind").isin(1, 2), "").when(after == 1, "],").when(after == 3, "]").when(F.col("kind") == 2, ",").otherwise("")
    told = followed(lines, order, ["kind"], "after").withColumn("value", F.concat("text", then))
    # of equal edges those with a comma after them come first
    told.repartitionByRange(*order).sortWithinPartitions(*order, "value").select("value").write.mode("overwrite").text(path)


def to_json(edges: DataFrame, states: DataFrame) -> DataFrame:
    """One row (json): the document of an LTS whose states are 0 to n - 1, each row sorted by label. For systems that fit a document."""
    step = F.struct(F.col("label"), F.col("dst").alias("process"))
    rows = states.join(edges.groupBy(F.col("src").alias("pid")).agg(F.sort_array(F.collect_list(step)).alias("row")), "pid", "left")
    row = F.coalesce("row", F.array().cast("array<struct<label: int, process: bigint>>"))
    doc = rows.agg(F.sort_array(F.collect_list(F.struct("pid", row.alias("row")))).alias("all"))
    return doc.select(F.to_json(F.struct(F.transform("all", lambda r: F.transform(r["row"], lambda t: F.struct(t["process"].alias("process"), t["label"].alias("label")))).alias("adj"))).alias("json"))


def universe(edges: DataFrame) -> DataFrame:
    """(pid): all states from 0 to the largest one mentioned, also those that no edge mentions."""
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first().m
    return edges.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("pid"))


def mentioned(edges: DataFrame) -> DataFrame:
    """(pid): the states that edges mention, for systems with sparse ids."""
    return edges.select(F.col("src").alias("pid")).union(edges.select("dst")).distinct()


# systems over the tables of a warehouse


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn leads by its role to the next turn of its conversation: state conv_id * 2^20 + turn."""
    at = lambda n: F.col("conv_id") * (1 << 20) + F.col("turn") + n
    return _table(spark, sf_dir, "conversations").select(at(0).alias("src"), at(1).alias("dst"), F.col("role").alias("label"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States (user, event type): user_id * 2^10 + first letters of the type; each event leads by the next one's type to it."""
    state = F.col("user_id") * (1 << 16) + F.ascii("event_type") * 256 + F.ascii(F.substring("event_type", 2, 1))
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", state.alias("src"))
    rows = followed(rows, ["user_id", "ts", "event_id"], ["user_id", "src", "event_type"], "after").where("user_id = after.user_id AND after.src IS NOT NULL")
    return rows.select("src", F.col("after.src").alias("dst"), F.col("after.event_type").alias("label")).distinct()


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers lead by priority to their orders, those by return flag and line status to the end: states 4c + 1, 4o + 2, 0."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    placed = orders.select((F.col("o_custkey") * 4 + 1).alias("src"), (F.col("o_orderkey") * 4 + 2).alias("dst"), F.col("o_orderpriority").alias("label"))
    shipped = items.select((F.col("l_orderkey") * 4 + 2).alias("src"), F.lit(0).cast("bigint").alias("dst"), F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("label")).distinct()
    return placed.unionByName(shipped)


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations lead by market segment to the balance bands (thousands) of their customers, and each band by ``up`` to the next that
    occurs one above: states nation, 2000 + band."""
    band = F.floor(F.col("c_acctbal") / 1000).cast("bigint") + 2000
    rows = _table(spark, sf_dir, "customer").where("c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL").select(F.col("c_nationkey").cast("bigint").alias("src"), band.alias("dst"), F.col("c_mktsegment").alias("label"))
    rows = rows.distinct()
    bands = rows.select("dst").distinct()
    up = bands.select(F.col("dst").alias("src")).join(bands.select("dst", (F.col("dst") - 1).alias("src")), "src").select("src", "dst", F.lit("up").alias("label"))
    return rows.unionByName(up)


def parcel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders lead by ``open`` to their parcels, the items of one tax rate, and each parcel by its items' return flags back to its order:
    a branching system with cycles. States: order * 64, and order * 64 + 1 + tax in percent."""
    order = F.col("l_orderkey").cast("bigint") * 64
    at = _table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL")
    at = at.groupBy(order.alias("order"), (order + 1 + F.round(F.col("l_tax") * 100).cast("bigint")).alias("parcel")).agg(F.collect_set("l_returnflag").alias("flags"))
    move = lambda src, dst, label: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), label.alias("label"))
    back = F.transform("flags", lambda f: move("parcel", "order", f))
    return at.select(F.inline(F.concat(F.array(move("order", "parcel", F.lit("open"))), back)))
