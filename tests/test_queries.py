"""Registered queries against their SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each kind; the driver runs all of them.
NAMES = (
    "mult_gram_supplier submatrix plus_transposed iamax nrm2 sort_vector pivot_symmetric iterate_until market_coordinate_symmetric json_sparse "
    "mult_tiles mvmult update2_sym ext_dot lu cholesky_solve bunch_kaufman qr lq_solve hyperbolic_apply svd tridiagonal_lower sturm_counts "
    "spgemm_customer_part sparse_pointers sparse_ic0"
).split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(float(r[k]) if isinstance(r[k], float) or hasattr(r[k], "as_tuple") else r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, DATA)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert ordered([tuple(r) for r in frame.collect()], frame.columns) == ordered(result.fetchall(), columns)


def test_entry_runs(spark):
    if not os.path.isdir(entry.SMALLEST):
        pytest.skip("no test tables here")
    assert entry.entry(spark).columns == ["i", "j", "v"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left_out", [["gridloom/llm", "tests/llm"], ["gridloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_core_does_not_need_the_training_data_part(tmp_path, left_out):
    shutil.copytree(entry.ROOT, tmp_path / "copy", ignore=lambda at, names: [n for n in names if n == ".git" or os.path.relpath(os.path.join(at, n), entry.ROOT) in left_out])
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    names, count = done.stdout.splitlines()
    assert "lu" in names.split() and "pipeline" not in names.split() and not any(n.startswith("op") for n in names.split()) and int(count) > 200


def test_a_broken_training_data_module_costs_only_that_part(tmp_path):
    at = tmp_path / "copy"
    shutil.copytree(entry.ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    broken = at / "gridloom" / "llm" / "queries.py"
    if not broken.exists():
        pytest.skip("the training-data part is not here")
    broken.write_text(broken.read_text() + "\nimport a_module_that_is_not_there\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(len(e.oracle_sql()))"], cwd=at, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    names, count = done.stdout.splitlines()
    assert "lu" in names.split() and "pipeline" not in names.split() and not any(n.startswith("op") for n in names.split()) and int(count) > 200
