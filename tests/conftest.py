import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import session

    s = session("local[4]", "tests", **{"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_driver_memory": "4g", "spark_ui_showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rows(df, *by):
    """Rows as sorted tuples of the given columns, or of all."""
    return sorted((tuple(r) for r in (df.select(*by) if by else df).collect()), key=str)
