"""The driver's contract: names, schemas, and that the rest stands without the text subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"p1_found", "p5_found"} <= set(e.queries())


def test_imports_without_a_session_and_without_the_text_package():
    code = (
        "import sys; sys.modules['quillspark.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not [k for k in e.queries() if k.startswith(('p2_', 'p3_', 'p4_', 'p6_', 'p7_', 'p8_'))]\n"
        "assert len(e.queries()) > 80"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode == 0


def test_nothing_imports_the_text_package():
    for p in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quillspark.llm" not in p.read_text()


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 5 and all(r.degree > 1 for r in rows)
