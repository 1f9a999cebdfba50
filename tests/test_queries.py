"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslens.plans.oracle import ORACLE_SQL
from corpuslens.plans.queries import QUERIES
from corpuslens.plans.storage import work_dir

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def rows_of():
    spec = importlib.util.spec_from_file_location("check_oracle", ROOT / "tools" / "check_oracle.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.rows_of


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, rows_of, name):
    df = entry.queries()[name](spark, str(DATA))
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200



def test_row_by_row_queries_move_no_rows(spark):
    for name in ("strip_tags", "html_to_text", "xml_text_nodes", "preview_corpus", "wrap_lines", "hex_dump", "md_tables"):
        assert "Exchange" not in QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString(), name


def test_entry_without_the_training_data_operators(tmp_path):
    for name in ("corpuslens", "__spark_entry__.py"):
        source = ROOT / name
        copy = shutil.copytree if source.is_dir() else shutil.copy
        copy(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "True"


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert work_dir(Session(spark_master="local[2]"), "x").startswith(tempfile.gettempdir())
    assert work_dir(Session(spark_master="yarn", spark_checkpoint_dir="s3://b/"), "x").startswith("s3://b/corpuslens/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session(spark_master="spark://h:7077"), "x")


@pytest.mark.parametrize("missing", ["corpuslens.llm", "corpus_pipeline", "xxhash"])
def test_entry_without_training_data_operators(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) >= 70
