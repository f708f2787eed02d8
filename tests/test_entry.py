import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_needs_no_subpackage():
    code = "import sys; sys.modules['trovelight.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "trovelight").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "trovelight").parts:
            assert "trovelight.llm" not in path.read_text(), path


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
