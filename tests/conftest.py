import os
import sys
from urllib.parse import urlparse

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pnlbook.session import checkpoint_root, get_spark, scratch_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", 8)
    checkpoint_root(s)          # the configured shared folder; a temp one only if unset
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    """A new folder below the session's shared checkpoint folder, as a local
    path (the tests also write and list files there with plain Python)."""
    uri = urlparse(scratch_dir(spark, "test"))
    assert uri.scheme in ("", "file"), "tests need a local checkpoint folder"
    os.makedirs(uri.path)
    return uri.path
