"""Chat formatting of reply trees.

Messages form trees by their parents. Self-joins double the distance that each message looks up its tree, so a thread of n
messages takes log2(n) joins; each round is written to the shared folder. From that come every leaf's depth, root and sum of
scores; the branches (root-to-leaf paths) of a tree are ranked by their mean score; and the paths of the chosen leaves are listed
by the same jumps, from the leaf up. Only then do texts join, and each path becomes one conversation.

Template of a turn: ``### role: text</turn>`` and a newline. Inside roles and texts a backslash goes before backslashes and the
control strings ``### `` and ``</turn>``, in roles also before colons; a backslash and any character read back as that character.
The loss mask is a list of spans (code points, end excluded) of the formatted text: the escaped text of each assistant turn.

Defined results: a null or unknown parent makes a root; null roles and texts count as empty; messages with a null id are left
out; messages in a cycle of parents have no root and are left out with all that reply to them; of repeated ids the first row (by
parent, score, role, text) counts; equal branch scores are ranked by leaf id; null scores count as 0; an empty table gives
none; other input columns are left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewise.llm.storage import written

ASSISTANT = "assistant"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_IN_TEXT = re.compile(r"\\|### |</turn>")
_IN_ROLE = re.compile(r"\\|### |</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(s: str, what: re.Pattern = _IN_TEXT) -> str:
    return what.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def format_turns(turns: list[tuple[str, str]], learn: str = ASSISTANT) -> tuple[str, list[tuple[int, int]]]:
    """One conversation and the spans of its loss mask."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, _IN_ROLE)}: ", escape(text)
        if role == learn:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), loss


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts again."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


def paths(messages: DataFrame, node: str = "id", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, branches: int | None = None) -> DataFrame:
    """root, leaf, branch_rank, branch_score and turns (role, text) of each chosen root-to-leaf path; ``branches`` is how many of each tree, all if None."""
    pick = lambda c: F.col(f"`{c}`")
    rows = messages.select(pick(node).alias("node"), pick(parent).alias("parent"), F.coalesce(pick(role), F.lit("")).alias("role"), F.coalesce(pick(text), F.lit("")).alias("text"), F.coalesce(pick(score).cast("double") if score else F.lit(0.0), F.lit(0.0)).alias("score"))
    rows = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("r")).select("node", "r.*")
    rows = written(rows, "messages")
    links = rows.select("node", "parent", "score")
    here = links.select(F.col("node").alias("parent"))
    state = links.join(here.withColumn("there", F.lit(True)), "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("node").alias("top"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    state = written(state, "jumps")
    jumps, most = [], max(1, rows.count()).bit_length()
    while state.where("up IS NOT NULL").limit(1).count() and len(jumps) <= most:
        jumps.append(state.where("up IS NOT NULL").select("node", "up"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("top").alias("a_top"), F.col("depth").alias("a_depth"), F.col("total").alias("a_total"))
        moved = state.where("up IS NOT NULL").join(above, "up").select("node", F.col("next").alias("up"), F.col("a_top").alias("top"), (F.col("depth") + F.col("a_depth")).alias("depth"), (F.col("total") + F.col("a_total")).alias("total"))
        state = written(state.where("up IS NULL").unionByName(moved), "jumps")
    leaves = state.where("up IS NULL").join(links.where("parent IS NOT NULL").select(F.col("parent").alias("node")), "node", "left_anti")
    leaves = leaves.select(F.col("node").alias("leaf"), F.col("top").alias("root"), (F.col("total") / F.col("depth")).alias("branch_score"), "depth")
    leaves = leaves.withColumn("branch_rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("branch_score"), "leaf")))
    if branches is not None:
        leaves = leaves.where(F.col("branch_rank") <= branches)
    leaves = written(leaves, "leaves")
    on_path = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("below"))
    for k, jump in enumerate(jumps):
        far = on_path.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("below") + (1 << k)).alias("below"))
        on_path = written(on_path.unionByName(far), "on-path")
    said = on_path.join(rows.select("node", "role", "text"), "node").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("below")).alias("place"), "role", "text"))).alias("turns"))
    return leaves.join(said, "leaf").select("root", "leaf", "branch_rank", "branch_score", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def formatted(chosen: DataFrame, learn: str = ASSISTANT) -> DataFrame:
    """Rows of ``paths`` with formatted and loss instead of turns."""
    kept = [f for f in chosen.schema.fields if f.name not in ("turns", "formatted", "loss")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField("formatted", T.StringType()), T.StructField("loss", SPANS)])
    arrow = to_arrow_schema(schema)
    n = len(kept)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [format_turns([(t["role"], t["text"]) for t in turns], learn) for turns in b.column(n).to_pylist()]
                columns = [c.cast(f.type) for c, f in zip(b.columns[:n], arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([m[0] for m in made], arrow.field(n).type), pa.array([[{"start": s, "end": e} for s, e in m[1]] for m in made], arrow.field(n + 1).type)], schema=arrow)

    return chosen.select(*[F.col(f"`{f.name}`") for f in kept], "turns").mapInArrow(run, schema)


def format_trees(messages: DataFrame, **how) -> DataFrame:
    """Each chosen path as one conversation: root, leaf, branch_rank, branch_score, formatted, loss."""
    return formatted(paths(messages, **how))
