"""Drift figures are rounded as the SQL rounds them."""

import datetime

import duckdb

from scholarmill.operators import monitoring


def test_medians_between_two_decimals_round_as_in_sql(spark):
    p = [18 / 1000.0 * (5 / 24.0 + 0.5), 19 / 1000.0 * (6 / 24.0 + 0.5), 30 / 1000.0 * (11 / 24.0 + 0.5)]
    rows = [(datetime.date(2024, k + 1, 1), "AI", x, "a title", None, None, None, None, None) for k, x in enumerate(p)]
    records = spark.createDataFrame(rows, "month date, label string, p double, title string, abstract string, doi string, institutions string, source string, decision string")
    got = {r.month.month: (r.previous, r.current) for r in monitoring.drift(records).where("measure = 'median_p'").collect()}
    want = [duckdb.sql("SELECT round(CAST(? AS DOUBLE), 4)", params=[x]).fetchall()[0][0] for x in p]
    assert got == {1: (None, want[0]), 2: (want[0], want[1]), 3: (want[1], want[2])}
