import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout
    return [line.split() for line in out.splitlines()[-2:]]


def test_every_oracle_has_a_query():
    found, sql = names(ROOT)
    assert set(sql) <= set(found)


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "traitloom", tmp_path / "traitloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found, sql = names(tmp_path)
    assert "trait_report" in found and not [n for n in found if n.startswith("op")] and set(sql) <= set(found)


def test_nothing_else_uses_the_corpus_operators():
    for f in (ROOT / "traitloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "traitloom.llm" not in f.read_text(), f


def test_a_broken_operator_is_no_absent_one(tmp_path):
    shutil.copytree(ROOT / "traitloom", tmp_path / "traitloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "traitloom" / "llm").mkdir()
    assert not [n for n in names(tmp_path)[0] if n.startswith("op")]  # an empty folder is no package
    (tmp_path / "traitloom" / "llm" / "__init__.py").touch()
    (tmp_path / "traitloom" / "llm" / "queries.py").write_text("import a_library_that_is_missing")
    code = "import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "a_library_that_is_missing" in out.stderr


def test_written_tables_can_be_forgotten(spark):
    from traitloom.session import forget, materialise

    held = materialise(spark.range(5), "held")
    assert held.count() == 5 and Path(held._traitloom_path).exists()
    forget(held)
    assert not Path(held._traitloom_path).exists()
