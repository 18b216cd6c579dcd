"""Shared plumbing: stores of one operator at a time, tables in the shared folder, an entry that works without this package."""

import subprocess
import sys

from ledgerloom.llm import common
from tests.conftest import ROOT


def test_claim_lets_other_stores_go():
    gone = []
    common.claim("a", lambda: gone.append("a"))
    common.claim("a", lambda: gone.append("a"))
    assert gone == []
    common.claim("b", lambda: gone.append("b"))
    assert gone == ["a"]


def test_materialize_and_drop(spark):
    df = common.materialize(spark.range(5).filter("id > 9"), "t")
    assert df.count() == 0 and df.columns == ["id"]
    full = common.materialize(spark.range(5), "t")
    assert sorted(r[0] for r in full.collect()) == [0, 1, 2, 3, 4] and full._ledgerloom_path.startswith(common.shared_dir(spark))
    common.drop_table(full)


def test_entry_works_without_this_package(tmp_path):
    hide = "import sys; sys.modules['ledgerloom.llm'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; print(len([q for q in e.queries() if q.startswith('op')]), len(e.queries()) > 100)"
    out = subprocess.run([sys.executable, "-c", hide, ROOT], capture_output=True, text=True, cwd=tmp_path, check=True)
    assert out.stdout.split() == ["0", "True"]


def test_freed_arrow_memory_goes_back():
    """What Arrow's pool keeps of freed batches is given back too, in a process of its own as a worker is."""
    code = """
import pyarrow as pa, pyarrow.compute as pc
from ledgerloom.llm import common

def held():
    return next(int(x.split()[1]) // 1024 for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:"))

base = pa.array(range(20_000))
pc.add(base, 1)
before = held()
kept = [pc.add(base, k) for k in range(1000)]
assert held() - before > 100
del kept
common.give_back()
assert held() - before < 30, held() - before
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
