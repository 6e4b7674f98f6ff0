import json
from pathlib import Path

import pytest

from ensemblecast.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4)


@pytest.fixture(scope="session")
def golden():
    return {p.stem: json.loads(p.read_text()) for p in (Path(__file__).parent / "data").glob("*.json")}
