"""The driver's contract, with and without the training-data subpackage."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, *rest):
        if name.startswith("sumac.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "flagship" in e.queries() and not [k for k in e.queries() if k.startswith("op") or k == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_a_broken_subpackage_is_no_absent_one():
    broken = WITHOUT.replace('name=name)', 'name="some_library")').replace("import __spark_entry__ as e", "")
    check = broken.split("assert")[0] + "try:\n    import __spark_entry__\nexcept ModuleNotFoundError:\n    sys.exit(0)\nsys.exit(1)\n"
    subprocess.run([sys.executable, "-c", check], cwd=ROOT, check=True, timeout=120)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "sumac").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
