import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_every_sql_has_its_query():
    import __spark_entry__ as registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and all(callable(f) for f in registry.queries().values())


def test_entry(spark):
    import __spark_entry__ as registry

    df = registry.entry(spark)
    assert df.columns == ["sum"] and df.first()[0] > 0


def test_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(f"{ROOT}/askframe", tmp_path / "askframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as r; q = r.queries(); assert 'count_simple' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; r.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, files in os.walk(f"{ROOT}/askframe"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(f"{folder}/{f}") as text:
                        assert "askframe.llm" not in text.read(), f


def test_works_where_an_import_of_the_operators_is_missing(tmp_path):
    """A broken import of the operators costs their queries, not the registry."""
    shutil.copytree(f"{ROOT}/askframe", tmp_path / "askframe", ignore=shutil.ignore_patterns("__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{f}"):
            shutil.copy(f"{ROOT}/{f}", tmp_path)
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as r; q = r.queries(); assert 'count_simple' in q and 'op8_warc' not in q and 'pipeline' not in q; r.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
