import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rankline.session import build_session
    s = build_session("local[4]", 8, app_name="rankline-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="rankline-test-ckpt-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="rankline-test-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
