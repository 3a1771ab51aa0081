"""A worker that outlives its tasks keeps little memory between them."""

import re
import sys

import pyarrow as pa
import pytest

from tracewise.llm import arrowmap, textops


def test_slices_are_small():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 4000})
    parts = list(textops.slices(batch, "t"))
    assert sum(p.num_rows for p in parts) == 4000 and max(p.num_rows for p in parts) <= 1100


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_memory_is_given_back_when_a_task_ends():
    def anon():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    def run(batches):
        for b in batches:
            held = [bytearray(60_000) for _ in range(3000)]  # below the size that is mapped on its own
            last = bytearray(60_000)  # stays, above what is free after it
            del held
            kept.append(last)
            yield b

    kept: list = []
    before = anon()
    batch = pa.RecordBatch.from_pydict({"t": ["a"]})
    assert list(arrowmap.trimmed(run)([batch])) == [batch]
    assert anon() - before < 60


def test_memory_is_given_back_when_a_task_fails(monkeypatch):
    told = []
    monkeypatch.setattr(arrowmap, "give_back", lambda: told.append(1))

    def run(batches):
        yield from batches
        raise ValueError("bad")

    with pytest.raises(ValueError, match="bad"):
        list(arrowmap.trimmed(run)([]))
    assert told == [1]
