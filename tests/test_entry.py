import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).parent.parent


def test_names_and_entry(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["event_type", "mean", "most", "rows"]


def test_nothing_else_needs_the_optional_subpackage(tmp_path):
    """A copy without it imports, and has all other queries."""
    import shutil

    for name in ("tidemark", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') and q[2].isdigit() or q == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.strip().endswith("[]") and int(out.split()[0]) > 90
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"tidemark\.llm|corpus_pipeline", path.read_text()), path
