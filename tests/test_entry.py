import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from weftframe import queries

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def normal(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, int) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(tuple(r[n] for n in names) for r in df.collect()) == normal(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["c_mktsegment", "n", "revenue"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    subprocess.run(["cp", "-r", str(ROOT / "weftframe"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "weftframe" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), "False"]


def test_a_missing_dependency_takes_only_the_corpus_operators(tmp_path):
    if not (ROOT / "weftframe" / "llm").exists():
        pytest.skip("the corpus operators aren't here")
    subprocess.run(["cp", "-r", str(ROOT / "weftframe"), str(ROOT / "__spark_entry__.py"), str(ROOT / "corpus_pipeline.py"), str(tmp_path)], check=True)
    (tmp_path / "weftframe" / "llm" / "packing.py").write_text("import no_such_module")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert "no_such_module" in out.stderr and out.stdout.split() == [str(len(queries.QUERIES))]
    hidden = subprocess.run([sys.executable, "-c", "import corpus_pipeline"], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert hidden.returncode and "no_such_module" in hidden.stderr
