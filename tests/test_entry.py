"""The driver contract without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lawtide.llm"):
            raise ModuleNotFoundError(name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
names = entry.queries()
assert "topic_counts" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
assert set(entry.oracle_sql()) <= set(names)
"""


def test_entry_without_the_operators():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)
