import random

import pytest
from pyspark.sql import functions as F

from tracewise.llm import chat as C
from tracewise.llm import queries as Q

NASTY = ["", "\\", "### ", "</turn>", "\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y</turn>\n", "\\\\</turn>\\", "<</turn>", "####  ", "a\nb", "é🙂</turn", "x" * 3000 + "</turn>" * 2000]


def test_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a:b", "\\", "### ", "x</turn>:", ""]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(0, 5))]
        made, loss = C.format_turns(turns)
        assert C.parse_turns(made) == turns
        assert [C.unescape(made[s:e]) for s, e in loss] == [t for r, t in turns if r == "assistant"]


def test_broken_text_is_refused():
    with pytest.raises(ValueError):
        C.parse_turns("### user: x")


def brute(rows, branches):
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[4] or 0.0, r[2] or "", r[3] or "")):
        first.setdefault(r[0], r)
    kids = {}
    for r in first.values():
        if r[1] in first:
            kids.setdefault(r[1], []).append(r[0])
    out = []
    for r in first.values():
        if r[1] not in first:
            found = []

            def go(n, path, found=found):
                path = [*path, n]
                for k in kids.get(n, []):
                    go(k, path)
                if n not in kids:
                    found.append((-sum(first[x][4] or 0.0 for x in path) / len(path), n, path))

            go(r[0], [])
            for k, (s, leaf, path) in enumerate(sorted(found)[:branches]):
                out.append((r[0], leaf, k + 1, round(-s, 9), [(first[x][2] or "", first[x][3] or "") for x in path]))
    return sorted(out)


@pytest.mark.parametrize("branches", [None, 2])
def test_trees_against_brute_force(spark, branches):
    rng = random.Random(2)
    rows = [(k, None if k % 17 == 0 else rng.randrange(max(0, k - 12), k), rng.choice(["user", "assistant", None]), rng.choice([*NASTY[:8], None]), rng.choice([0.5, 1.0, 2.0, None])) for k in range(120)]
    rows += [(7, 3, "user", "again", 1.0), (None, 3, "user", "lost", 1.0), (500, 9999, "user", "orphan", None), (601, 602, "u", "c", 1.0), (602, 601, "u", "c", 1.0), (603, 602, "u", "c", 1.0), (604, 604, "u", "self", 1.0)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "id long, parent long, role string, text string, score double, root string")
    got = C.paths(d, score="score", branches=branches).collect()
    want = brute([r for r in rows if (r[0] or 0) < 600], branches)
    assert sorted((r.root, r.leaf, r.branch_rank, round(r.branch_score, 9), [(t.role, t.text) for t in r.turns]) for r in got) == want


def test_empty(spark):
    d = spark.createDataFrame([], "id long, parent long, role string, text string")
    assert C.format_trees(d).collect() == []


def test_query_reads_back_what_went_in(spark, tmp_path):
    import hashlib

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", NASTY[4]), (1, 2, None, None), (2, 5, "assistant", None), (2, 3, "user", NASTY[5]), (2, 5, "assistant", "tie"), (None, 0, "assistant", "x"), (3, 0, "system", "s")]
    rows += [(9, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in Q.op4_chat(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", NASTY[4]), (-7, 1, "assistant", NASTY[4])]
    want = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].formatted_chars == len(C.format_turns(turns)[0])
