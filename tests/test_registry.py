"""Every registered query at a small scale, against DuckDB where SQL can say it."""

import os
import shutil
import subprocess
import sys

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    return oracle.oracle(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    ok, count, detail = oracle.compare(spark, connection, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    if name in ORACLES:
        (columns, got), (wanted_columns, wanted) = detail
        assert columns == wanted_columns
        assert got == wanted
    else:
        assert count > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left_out", [["ontoweave/llm", "corpus_pipeline.py"], ["ontoweave/llm"], ["corpus_pipeline.py"]])
def test_the_rest_works_without_the_training_data_modules(tmp_path, left_out):
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("ontoweave", "workload"):
        shutil.copytree(f"{ROOT}/{name}", copy / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", copy / name)
    for name in left_out:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print('node_graph' in q, 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.stdout.split() == ["True", "False"], done.stderr[-2000:]


def test_a_broken_training_data_module_is_an_error(tmp_path):
    if not os.path.isdir(f"{ROOT}/ontoweave/llm"):
        pytest.skip("not installed")
    copy = tmp_path / "copy"
    shutil.copytree(f"{ROOT}/ontoweave", copy / "ontoweave", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copytree(f"{ROOT}/workload", copy / "workload", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", copy / "__spark_entry__.py")
    (copy / "ontoweave/llm/queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True)
    assert "no_such_module" in done.stderr
