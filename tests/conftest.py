import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from notegraph.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Whether a query gives the rows of its SQL, columns by name, rows in any order."""

    def check(query, sql):
        df = query(spark, SF)
        found = sorted(tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        wanted = sorted(tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert found == wanted

    return check
