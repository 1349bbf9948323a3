"""Registered queries over small tables of the driver's schema."""

from datetime import date

import pytest
from pyarrow import parquet

from tests.mini import rows
from tramline.plans.registry import QUERIES

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint",
    "supplier": "s_suppkey bigint",
    "part": "p_partkey bigint, p_name string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}
PAGE = "<html><body><article><p>Line {0}</p></article></body></html>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Trips 2 and 8 of one feed on weekdays, captured on 2026-10-07 and on 2026-10-27."""
    folder = str(tmp_path_factory.mktemp("tables"))
    sql = "SELECT {0}L, TIMESTAMP_NTZ '{1}', {2}L, 'click', 20D, '{{\"k\": 3}}'"
    events = [sql.format(1, "2024-01-02 06:00:00", 1), sql.format(4, "2024-01-22 06:00:00", 2)]
    given = {
        "nation": [(0, "EAST", 1)], "customer": [(1,), (2,)], "supplier": [(1,)],
        "part": [(1, "north pier", 3), (2, "south pier", 4)],
        "orders": [(2, 25, "1-URGENT"), (8, 25, "1-URGENT")],
        "lineitem": [(2, 1, 1, 1, "N"), (8, 2, 1, 1, "N")],
        "pages": [(n, f"https://example.org/{n}", PAGE.format(n)) for n in (3, 9, 10, 20)],
    }
    for name, schema in SCHEMAS.items():
        df = spark.sql(" UNION ALL ".join(events)).toDF(*[c.split()[0] for c in schema.split(", ")]) \
            if name == "events" else spark.createDataFrame(given[name], schema)
        parquet.write_table(df.toArrow(), f"{folder}/{name}.parquet")
    return folder


def test_live_board_covers_every_capture(spark, tables):
    board = QUERIES["stream_live_board"](spark, tables)
    assert rows(board, "service_date", "trip_id", "capture_id", "delay_seconds") == [
        (date(2026, 10, 7), "T2", "C20733", -40), (date(2026, 10, 27), "T8", "C20753", None)]


def test_feed_status_counts_planned_pages(spark, tables):
    found = rows(QUERIES["feed_status"](spark, tables), "feed_id", "drift_findings")
    assert found == [("F0", 1), ("F1", 0), ("F2", 0)]
