"""Cooldowns at their edge: fractions of a second count, as in SQL."""

import duckdb
import pytest

from plazamill import registry

from .test_queries import SF, plain


@pytest.mark.parametrize("name, at", [("v23_cooldown", "2024-01-31 00:00:00"), ("v24_cooldown_partition", "2024-01-30 12:00:00")])
def test_cooldown_counts_microseconds(spark, tmp_path, name, at):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    steps = ", ".join(map(str, (-1_000_000, -500_000, -1, 0, 1, 500_000, 999_999, 1_000_000)))
    # one institution a step and policy: last evaluated as many microseconds after the moment at which it is due
    con.sql(f"""CREATE TABLE events AS SELECT row_number() OVER () * 5 + p AS event_id, TIMESTAMP '{at}' - to_hours([12, 3, 6, 12, 48][p + 1]) + to_microseconds(s) AS ts, row_number() OVER () - 1 AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '{{"k": 0}}' AS props
     FROM (SELECT unnest([{steps}])::BIGINT AS s), (SELECT unnest(range(5)) AS p)""")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    for t in ("nation", "region", "customer"):
        con.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    con.sql("CREATE VIEW orders AS SELECT * FROM '%s/orders.parquet'" % SF)
    con.sql("CREATE VIEW lineitem AS SELECT * FROM '%s/lineitem.parquet'" % SF)
    want = con.sql(registry.SQL[name])
    out = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(map(plain, r)) for r in out.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())
