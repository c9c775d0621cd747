import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", [q for q in ORACLES if not q.startswith("op")])
def test_matches_its_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("gone", [["tracelake/llm"], ["tracelake/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_imports_without_the_training_data_operators(tmp_path, gone):
    """The entry module still works where the operators, the pipeline or both are deleted."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tracelake", tmp_path / "tracelake")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    for name in gone:
        subprocess.run(["rm", "-rf", str(tmp_path / name)], check=True)
    script = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 50 and 'pipeline' not in names and not any(q.startswith('op') for q in names) and len(e.oracle_sql()) > 50 and e.__file__.startswith(%r)"
    # The folder's own files alone: nothing of this repository may be on the path.
    subprocess.run([sys.executable, "-c", script % str(tmp_path)], check=True, timeout=120, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)})
