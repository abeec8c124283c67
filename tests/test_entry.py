"""The entry is importable with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = """
import sys
{block}
import __spark_entry__ as e
print(len(e.queries()), sum(n.startswith("op") or n == "pipeline" for n in e.queries()),
      set(e.oracle_sql()) <= set(e.queries()))
"""


def counts(block=""):
    done = subprocess.run([sys.executable, "-c", COUNT.format(block=block)], cwd=ROOT,
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    total, numbered, known = done.stdout.split()
    assert known == "True"
    return int(total), int(numbered)


@pytest.mark.parametrize("absent", ["logstrata.llm", "corpus_pipeline", "ahocorasick"])
def test_entry_without(absent):
    total, numbered = counts()
    if numbered == 0:
        pytest.skip("no training-data operators here")
    assert counts(f"sys.modules[{absent!r}] = None") == (total - numbered, 0)
