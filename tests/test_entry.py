import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_rest_imports_without_the_corpus_operators(tmp_path):
    for p in REPO.rglob("*.py"):
        part = p.relative_to(REPO)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py" and ".git" not in part.parts:
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(x for x in q if x[2:3].isdigit() or x == 'pipeline'))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.strip().endswith("[]") and int(out.stdout.split()[0]) > 40
