import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scoutml.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("*", 8)


@pytest.fixture()
def rng():
    return np.random.default_rng(7)


def points_df(spark, x, labels=None):
    rows = [(int(i), [float(v) for v in x[i]]) + ((int(labels[i]),) if labels is not None else ()) for i in range(len(x))]
    schema = "id long, x array<double>" + (", cluster int" if labels is not None else "")
    return spark.createDataFrame(rows, schema)
