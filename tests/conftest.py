import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from grainmill.session import local_session

    return local_session("8", 4)


@pytest.fixture(params=[False, True], ids=["broadcast", "shuffled"])
def many_buckets(request, monkeypatch):
    """Runs a test with few ranges and as if there were too many to broadcast."""
    from grainmill.operators import ordering

    if request.param:
        monkeypatch.setattr(ordering, "BROADCAST_RANGES", 0)
        monkeypatch.setattr(ordering, "MIN_RANGES", 200)
    return request.param
