"""The entry without its optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["corpus_pipeline", "earshot.llm", "xxhash"])
def test_core_queries_without_corpus_operators(missing):
    """A module that cannot be imported leaves all other queries."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), *[q for q in e.queries() if q[:2] == 'op' or q == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, *corpus = done.stdout.split()
    assert int(count) > 200 and corpus == [] and "left out" in done.stderr
