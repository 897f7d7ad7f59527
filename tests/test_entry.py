"""The entry module keeps the engine's queries whatever the corpus operators lack."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_a_library():
    for name in ("zstandard", "routeloom.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'q_flagship' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
