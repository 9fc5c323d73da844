"""The driver's entry file, with and without its optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import importlib.abc, sys
class Blocked(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if any(name == b or name.startswith(b + ".") for b in {names!r}):
            raise ModuleNotFoundError(name)
find = __import__("importlib.util", fromlist=["util"]).find_spec
import importlib.util
importlib.util.find_spec = lambda n, p=None: None if n in {names!r} else find(n, p)
sys.meta_path.insert(0, Blocked())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print(sorted(e.queries()))
assert set(e.oracle_sql()) <= set(e.queries())
assert not any(m.startswith({names!r}) for m in sys.modules)
"""


@pytest.mark.parametrize(
    "names", [("tablewise.llm",), ("tablewise.llm", "corpus_pipeline"), ("corpus_pipeline",)]
)
def test_import_without_optional_parts(names):
    code = BLOCKED.format(names=names, root=ROOT)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "p15_health_score" in done.stdout and "pipeline" not in done.stdout
