"""The driver's module loads wherever PySpark lives, and one query's SQL cannot take the others down."""

import os
import subprocess
import sys
import warnings

import __spark_entry__ as E
from veilspark.operators.modifiers import default_stop_words
from veilspark.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stop_words_are_sparks_own(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert default_stop_words() == StopWordsRemover.loadDefaultStopWords("english")


def test_import_with_pyspark_inside_a_zip():
    """A fresh process whose ``pyspark.__file__`` points into an archive: no file beside it may be read."""
    code = ("import pyspark; pyspark.__file__ = '/nowhere/pyspark.zip/pyspark/__init__.py'; "
            "pyspark.__path__ = list(pyspark.__path__); import __spark_entry__ as E; "
            "assert set(E.oracle_sql()) <= set(E.queries()); print(len(E.queries()), len(E.oracle_sql()))")
    out = subprocess.run([sys.executable, "-W", "error::UserWarning", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n_queries, n_sql = map(int, out.stdout.split())
    assert n_queries == len(E.queries()) and n_sql == len(E.oracle_sql())


def test_missing_training_package_is_allowed_and_other_failures_are_not():
    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as E; print(len(E.queries()))"
    ok = subprocess.run([sys.executable, "-c", code.format("veilspark.llm")], cwd=ROOT, capture_output=True, text=True)
    assert ok.returncode == 0 and int(ok.stdout) == len(catalog.QUERIES), ok.stderr
    if E.llm_queries:
        bad = subprocess.run([sys.executable, "-c", code.format("public_tokenizers")], cwd=ROOT, capture_output=True, text=True)
        assert bad.returncode != 0 and "public_tokenizers" in bad.stderr


def test_one_failing_sql_leaves_the_others(monkeypatch):
    def broken():
        raise RuntimeError("no SQL today")
    whole = E.oracle_sql()
    monkeypatch.setitem(catalog.ORACLES, "stop_words", broken)
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        left = E.oracle_sql()
    assert set(whole) - set(left) == {"stop_words"}
