from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)


@pytest.fixture(scope="session")
def spark():
    from loomflow.session import local_session, share_code

    os.environ.setdefault("LOOMFLOW_DRIVER_MEMORY", "4g")
    session = local_session(cpus=4, partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    share_code(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
