import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("lost", ["folders", "dependency"])
def test_entry_without_the_training_data_operators(tmp_path, lost):
    """The other queries stay where that part is gone, and where something that it needs cannot be imported."""
    for name in ("graftline", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    if lost == "folders":
        subprocess.run(["rm", "-rf", str(tmp_path / "graftline" / "llm"), str(tmp_path / "corpus_pipeline.py")], check=True)
    else:
        (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1:] == ["False", "True"] and int(out.stdout.split()[0]) > 60


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_flagship_query_equals_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df = entry.entry(spark)
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()['simple_update']})").fetchall()
    assert got == sorted(map(str, want)) and got


def test_the_guard_is_in_the_entry_alone():
    assert importlib.util.find_spec("graftline.plans.registry")
    for folder, _, files in os.walk(os.path.join(ROOT, "graftline")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "graftline.llm" not in text.read(), f
