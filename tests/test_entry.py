import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent


def test_every_query_is_callable_and_named_once():
    import __spark_entry__ as driver

    queries, sql = driver.queries(), driver.oracle_sql()
    assert all(map(callable, queries.values())) and set(sql) <= set(queries)
    assert len(sql) > 40


def test_the_rest_imports_without_the_corpus_folder(tmp_path):
    import shutil

    shutil.copytree(TOP / "tallyfold", tmp_path / "tallyfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as d; q = d.queries(); assert 'trade_metrics' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})


def test_nothing_else_imports_the_corpus_folder():
    for path in (TOP / "tallyfold").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallyfold.llm" not in path.read_text()
