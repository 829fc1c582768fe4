import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry_gives_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["host", "n", "p5", "median", "p95", "score"] and frame.count() > 0


def test_twins_belong_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_the_rest_works_without_the_training_data_operators():
    code = "import sys; sys.modules['diagspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
