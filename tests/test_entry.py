"""The entry point with parts of it missing."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked} or name in {blocked}:
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
print(len(e.queries()), *(n for n in e.queries() if n[:2] == "op" and n[2].isdigit() or n == "pipeline"))
"""


def listed(*blocked):
    code = LIST.replace("{blocked}", repr(set(blocked)))
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split(), out.stderr


def test_a_missing_module_takes_only_the_corpus_queries_along():
    from workload import cleaning, matching, records

    own = sum(len(m.QUERIES) for m in (cleaning, matching, records))
    for blocked in ("public_tokenizers", "sourcemeld.llm"):
        names, told = listed(blocked)
        assert names == [str(own)] and blocked in told


def test_a_missing_pipeline_leaves_the_rest():
    names, _ = listed("corpus_pipeline")
    assert "pipeline" not in names
