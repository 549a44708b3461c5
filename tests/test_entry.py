import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """With both folders and the pipeline removed the entry module imports, an engine query runs, and all other tests can
    be collected."""
    copy = tmp_path / "repo"
    copy.mkdir()
    for name in ("__spark_entry__.py", "bench.py", "sparkveil", "tests"):
        subprocess.run(["cp", "-r", str(REPO / name), str(copy / name)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "sparkveil/llm"), str(copy / "tests/llm")], check=True)
    code = (
        "import __spark_entry__ as e; q = e.queries(); assert 'email_mask' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q)\n"
        "from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert q['check_digit'](s, '/root/testdata/sf0.001').count() == 1500"
    )
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]


def test_import_errors_within_the_corpus_operators_show(tmp_path):
    copy = tmp_path / "repo"
    (copy / "sparkveil").mkdir(parents=True)
    (copy / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    subprocess.run(["cp", "-r", *(str(REPO / "sparkveil" / n) for n in ("__init__.py", "plans", "functions", "operators", "sources")), str(copy / "sparkveil")], check=True)
    (copy / "sparkveil/llm").mkdir()
    (copy / "sparkveil/llm/__init__.py").write_text("")
    (copy / "sparkveil/llm/queries.py").write_text("import no_such_module_here\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True)
    assert done.returncode and "no_such_module_here" in done.stderr
