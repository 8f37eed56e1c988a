"""The entry module: names agree, the flagship query runs, and the rest stands without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    queries = entry.queries()
    assert not set(entry.oracle_sql()) - set(queries)
    assert len(queries) > 50 and all(callable(f) for f in queries.values())


def test_flagship(spark):
    if Path("/root/testdata/sf0.001").exists():
        out = entry.entry(spark)
        assert out.columns == ["doc_id", "score", "rank"] and 0 < out.count() <= 10


def test_without_llm(tmp_path):
    import shutil

    for name in ("glosswork", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "glosswork" / "llm", ignore_errors=True)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'postings' in q and not any(k[:2] == 'p8' for k in q); e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
