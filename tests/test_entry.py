import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["position", "name", "score", "n_trials", "error"]
    assert df.count() == 3


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
