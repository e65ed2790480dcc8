import datetime

import duckdb

from mnemoframe.plans import catalog, insight  # noqa: F401


def test_growth_rounds_halves_as_its_sql(spark, tmp_path):
    """Means whose double lies beside the half that their digits name, or on it where the digits lie below."""
    values = {1: [1.0, 1.01], 2: [45.824999999999996], 3: [-1.0, -1.01], 4: [0.5, 10.0, 20.0], 5: [2.5] * 16 + [0.1]}
    rows = [(k, datetime.datetime(2024, 1, 30, 12), u, v) for k, (u, v) in enumerate((u, v) for u, vs in values.items() for v in vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: tuple(r) for r in catalog.QUERIES["a34_growth"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view events as select event_id, ts::timestamp as ts, user_id, value from '{tmp_path}/events.parquet/*.parquet'")
    assert got == {r[0]: r for r in db.execute(catalog.ORACLE_SQL["a34_growth"]).fetchall()}
    assert (got[1][3], got[2][3]) == (1.0, 45.83)
