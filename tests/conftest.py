import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from graphlens.session import local_session, ship

    s = local_session(4, 2, "3g")
    s.conf.set("spark.sql.codegen.wholeStage", "false")  # tables of a few rows: compiling costs more than running
    ship(s)
    yield s
    s.stop()


@pytest.fixture()
def rows():
    """Rows of a DataFrame as a sorted list of tuples, columns in the order given."""
    def get(df, *cols):
        return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)

    return get
