"""The entry without the optional operators or their libraries."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_a_missing_library_leaves_the_other_queries():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert len(e.queries()) > 90 and set(e.oracle_sql()) <= set(e.queries()); assert not e.HAS_LLM"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
