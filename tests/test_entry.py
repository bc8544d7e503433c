"""The entry module without the operators, and without what only they need; test modules by name."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(len(entry.queries()), sum(n.startswith("op") or n == "pipeline" for n in entry.queries()))
"""


def counted(name):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), name=name)], capture_output=True, text=True)
    return done.stdout.split(), done.stderr


@pytest.mark.parametrize("name", ["xxhash", "sentencepiece", "tripstrata.llm", "corpus_pipeline"])
def test_warehouse_queries_do_without_the_operators(name):
    (whole, _), _ = counted("no.such.module")
    (left, operators), _ = counted(name)
    assert operators == "0" and 100 < int(left) <= int(whole)


def test_other_missing_modules_are_faults():
    out, error = counted("tripstrata.operators")
    assert out == [] and "tripstrata.operators" in error


def test_no_two_test_modules_share_a_name():
    names = Counter(path.name for path in (ROOT / "tests").rglob("test_*.py"))
    assert [name for name, n in names.items() if n > 1] == []
