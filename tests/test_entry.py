"""The driver's contract holds with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_without_llm(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("graphloom", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "graphloom").mkdir()
    for p in (ROOT / "graphloom").iterdir():
        if p.name != "llm":
            (tmp_path / "graphloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pagerank' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
