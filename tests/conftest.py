import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerframe.session import build_session, checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", app="ledgerframe-tests", shuffle_partitions=4, driver_memory="4g")
    if not checkpoint_dir(s):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerframe-test-ckpt-"))
    yield s
    s.stop()
