import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from filecover.session import local_session

    session = local_session("8", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def manifest(spark):
    def make(rows):
        return spark.createDataFrame([(p, int(s), float(t)) for p, s, t in rows], "path string, size bigint, mtime double")

    return make


@pytest.fixture
def tree(tmp_path):
    """Write {relative path: bytes, or (bytes, mtime)} below a named directory."""

    def make(name, files):
        for relative, content in files.items():
            data, at = content if isinstance(content, tuple) else (content, 1_700_000_000)
            target = tmp_path / name / relative
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)
            os.utime(target, (at, at))
        (tmp_path / name).mkdir(exist_ok=True)
        return str(tmp_path / name)

    return make
