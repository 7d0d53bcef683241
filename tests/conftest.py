import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from arborix.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


FILE = "id long, path string, name string, size long, modified double, hash string, is_directory boolean, is_file boolean, is_symlink boolean, parent_path string, traversed boolean, traverse_error string"


@pytest.fixture(scope="session")
def make_files(spark):
    """Build file rows from (path, content hash or None for a folder) pairs or full dicts."""

    def build(entries):
        rows = []
        for i, e in enumerate(entries, 1):
            e = e if isinstance(e, dict) else {"path": e[0], "hash": e[1]}
            folder = e.get("is_directory", e.get("hash") is None)
            parent = e["path"].rpartition("/")[0] if e.get("path") else None
            base = {"id": i, "name": e["path"].rpartition("/")[2] if e.get("path") else None, "size": 0 if folder else 10, "modified": 1.7e9, "is_directory": folder, "is_file": not folder, "is_symlink": False, "parent_path": parent or None, "traversed": False, "traverse_error": None, "hash": None}
            row = base | e
            rows.append(tuple(row[c.split()[0]] for c in FILE.split(", ")))
        return spark.createDataFrame(rows, FILE)

    return build
