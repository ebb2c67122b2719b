"""The driver's contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    return sorted(str([None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r]) for r in df)


@pytest.mark.parametrize("name", sorted(entry.engine.SQL))
def test_queries_equal_their_sql(spark, small, name):
    df = entry.queries()[name](spark, small)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    plain = lambda rows: rows_of([[x.isoformat() if hasattr(x, "isoformat") else x for x in r] for r in rows])
    assert plain(map(tuple, df.select(*names).collect())) == plain(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "prompt_variant"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _copy(to, *left_out):
    for name in ("__spark_entry__.py", "lexiloom", "tests", "corpus_pipeline.py"):
        source = f"{ROOT}/{name}"
        if os.path.isdir(source):
            shutil.copytree(source, to / name, ignore=shutil.ignore_patterns("__pycache__", *left_out))
        elif name not in left_out and os.path.exists(source):
            shutil.copy(source, to / name)


def _run(folder, code):
    paths = [str(folder), *[p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]]
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": os.pathsep.join(paths)}, capture_output=True, text=True)


REST = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_imports_without_llm(tmp_path, left_out):
    _copy(tmp_path, *left_out)
    done = _run(tmp_path, REST)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(entry.llm is None, reason="the subpackage is not there")
def test_a_broken_subpackage_is_an_error(tmp_path):
    _copy(tmp_path)
    (tmp_path / "lexiloom" / "llm" / "iblt.py").write_text("import lexiloom.llm.nothing_of_this_name\n")
    done = _run(tmp_path, REST)
    assert done.returncode != 0 and "nothing_of_this_name" in done.stderr


def test_missing_libraries_leave_the_subpackage_out(tmp_path):
    _copy(tmp_path)
    hide = "import sys, importlib.abc\nclass H(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name == 'sentencepiece': raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, H())\n"
    done = _run(tmp_path, hide + REST)
    assert done.returncode == 0, done.stderr


def test_the_rest_of_the_tests_run_without_llm(tmp_path):
    """A few files of the rest, in a copy without both folders and the pipeline."""
    _copy(tmp_path, "llm", "corpus_pipeline.py")
    code = "import pytest, sys; sys.exit(pytest.main(['-x', '-q', 'tests/test_functions.py', 'tests/test_resolve.py', 'tests/test_entry.py', '-k', 'not without_llm and not subpackage and not equal_their_sql']))"
    done = _run(tmp_path, code)
    assert done.returncode == 0, done.stdout[-2000:]
