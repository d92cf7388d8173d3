import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert "containment1" in df.columns and df.count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values()))


def test_works_without_the_llm_part(tmp_path):
    for p in ROOT.glob("*.py"):
        if p.name != "corpus_pipeline.py":
            (tmp_path / p.name).write_text(p.read_text())
    for p in (ROOT / "kmerlake").rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_llm_part():
    for p in (ROOT / "kmerlake").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p
