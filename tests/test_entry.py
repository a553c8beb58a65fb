"""The driver contract, with and without the text operators."""

import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]

BLOCKED = """
import sys

class Block:
    def find_spec(self, name, path=None, target=None):
        if name in {blocked!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
names = set(entry.queries())
print(len(names), any(n.startswith("op") or n == "pipeline" for n in names), set(entry.oracle_sql()) <= names)
"""


def run(blocked):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    return done.stdout.split()[-3:], done.stderr


@pytest.mark.parametrize("blocked", [["motorpool.llm", "corpus_pipeline"], ["motorpool.llm"], ["corpus_pipeline"]])
def test_entry_without_the_text_operators(blocked):
    said, _ = run(blocked)
    assert int(said[0]) > 150 and said[1:] == ["False", "True"]


def test_a_library_that_only_text_operators_need_is_told():
    if not (ROOT / "motorpool" / "llm").exists():
        pytest.skip("the text operators are not here")
    said, error = run(["tiktoken"])
    assert int(said[0]) > 150 and said[1:] == ["False", "True"] and "tiktoken" in error
