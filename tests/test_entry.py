"""The entry module works without the training-data subpackage, and swallows no other import error."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def copy(tmp_path):
    for name in ("__spark_entry__.py", "triloom"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    return tmp_path


def run(where):
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q)"
    return subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(where)})


def test_without_the_subpackage(tmp_path):
    out = run(copy(tmp_path))
    assert out.returncode == 0, out.stderr
    n, pipeline = out.stdout.split()
    assert int(n) > 150 and pipeline == "False"


def test_other_import_errors_are_told(tmp_path):
    where = copy(tmp_path)
    (where / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in run(where).stderr


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "triloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "triloom.llm" not in f.read_text(), f


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "feature" and df.count() >= 0
