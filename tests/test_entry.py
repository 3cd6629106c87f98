"""The driver's contract, with and without the optional subpackage."""

import ast
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = """
import __spark_entry__ as e
names = e.queries()
assert "ppi_mean" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_a_fault_inside_the_optional_parts_is_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (tmp_path / "repo/marlstone/llm").mkdir()
    (tmp_path / "repo/marlstone/llm/__init__.py").write_text("import nothing_of_this_name\n")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert "nothing_of_this_name" in found.stderr


def test_queries_and_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    for p in (ROOT / "marlstone").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "marlstone").parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any(x.startswith("marlstone.llm") or x == "corpus_pipeline" for x in names), p


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    r = e.entry(spark).collect()
    assert len(r) == 1 and r[0].ci_lo < r[0].theta_pp < r[0].ci_hi
