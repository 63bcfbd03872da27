import glob
import os

import duckdb
import pytest

from mosaiq.runtime import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    found.sparkContext.setLogLevel("ERROR")
    found.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield found
    found.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return repr(float(x))
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return repr([plain(y) for y in x]) if not hasattr(x, "item") or getattr(x, "ndim", 0) else plain(x.item())
    return str(x)


def same_rows(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted([tuple(plain(r[c]) for c in names) for r in df.collect()], key=repr)
    at = [relation.columns.index(c) for c in names]
    theirs = sorted([tuple(plain(r[k]) for k in at) for r in relation.fetchall()], key=repr)
    assert ours == theirs
