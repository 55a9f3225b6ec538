import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fleetstate.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="fleetstate-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as sorted tuples."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
