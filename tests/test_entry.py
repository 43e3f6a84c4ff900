from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_is_read_without_a_session() -> None:
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and s.keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
