"""DuckDB twins of the registered queries."""

from __future__ import annotations

from tramline.functions import text as tx
from tramline.operators import artifacts, profile, quality
from tramline.plans import oracle_views as v

ORACLE: dict[str, str] = {}

ORACLE["departures"] = v.sql(f"""
SELECT query_id, feed_id, stop_id, route_id, route_short_name, route_long_name, route_type,
  headsign, direction_id, trip_id, stop_sequence, service_id, service_date, gtfs_time,
  departure_epoch, {v.local_iso('departure_epoch', 'zone')} AS departure_local, minutes_away,
  after_midnight, rank, total FROM departures""")

_T = {"a": ["agency", "calendar", "calendar_dates", "feed_info", "routes", "stop_times", "stops",
            "trips"]}


def _counts(side: str, tables=None) -> str:
    return " UNION ALL ".join(
        f"SELECT feed_id, snapshot_id, '{t}' AS table_name, count(*) AS n FROM {t}_{side} "
        "GROUP BY ALL" for t in (tables or _T["a"]))


ORACLE["feed_gate"] = v.sql(f"""
SELECT feed_id, snapshot_id, sum(n)::BIGINT AS total_rows,
  coalesce(sum(CASE WHEN table_name = 'stops' THEN n END), 0)::BIGINT AS stop_rows,
  CASE WHEN coalesce(sum(CASE WHEN table_name = 'stops' THEN n END), 0) = 0 THEN 'NO_STOPS' ELSE ''
    END AS reason,
  coalesce(sum(CASE WHEN table_name = 'stops' THEN n END), 0) > 0 AS accepted
FROM ({_counts('a')} UNION ALL {_counts('b')} UNION ALL
  SELECT feed_id, 'C', table_name, n FROM ({_counts('b')}) WHERE table_name <> 'stops')
GROUP BY 1, 2""")

ORACLE["optional_columns"] = v.sql(
    "SELECT feed_id, snapshot_id, stop_id, stop_name, '' AS platform_code, '' AS stop_desc "
    "FROM stops_a")

ORACLE["stop_search"] = v.sql("""
SELECT feed_id, term, stop_id, stop_code, stop_name FROM stops_a,
  (SELECT unnest(['red', 'RING', '_', 'll w']) AS term)
WHERE contains(lower(stop_name), lower(term))""")

ORACLE["stop_search_by_code"] = v.sql("""
SELECT feed_id, stop_id, stop_code FROM stops_a s WHERE EXISTS (
  SELECT 1 FROM board_queries q WHERE q.feed_id = s.feed_id AND q.needle = s.stop_code)""")

ORACLE["stop_search_by_route"] = v.sql("""
SELECT DISTINCT s.feed_id, t.route_id, s.stop_id, s.stop_name FROM stops_a s
JOIN stop_times_a st ON st.feed_id = s.feed_id AND st.stop_id = s.stop_id
JOIN trips_a t ON t.feed_id = st.feed_id AND t.trip_id = st.trip_id""")

_TYPE_NAME = ("CASE trim({0}) WHEN '0' THEN 'tram/streetcar' WHEN '1' THEN 'subway' WHEN '2' THEN "
              "'rail' WHEN '3' THEN 'bus' WHEN '11' THEN 'trolleybus' ELSE 'type ' || {0} END")

ORACLE["route_search"] = v.sql(f"""
SELECT r.feed_id, term, r.route_id, route_short_name, route_long_name, route_type,
  {_TYPE_NAME.format('route_type')} AS route_type_name, coalesce(n, 0) AS trip_count
FROM routes_a r CROSS JOIN (SELECT unnest(['nation_1', 'l2', '%']) AS term)
LEFT JOIN (SELECT feed_id, route_id, count(*) AS n FROM trips_a GROUP BY ALL) t
  ON t.feed_id = r.feed_id AND t.route_id = r.route_id
WHERE contains(lower(concat_ws(' ', r.route_id, route_short_name, route_long_name, route_type,
  route_color)), lower(term))""")

ORACLE["boardable_filter"] = v.sql("""
SELECT feed_id, snapshot_id, count(*) AS calls, any_value(n) AS stops FROM stop_times_a
JOIN (SELECT feed_id, count(*) AS n FROM stops_a WHERE location_type IN ('', '0') GROUP BY 1)
  USING (feed_id)
WHERE departure_time <> '' AND pickup_type <> '1' GROUP BY 1, 2""")

ORACLE["gtfs_time_parse"] = v.sql(f"""
SELECT departure_time, s AS seconds, {v.clock('s')} AS formatted, n FROM (
  SELECT departure_time, {v.seconds('departure_time')} AS s, count(*) AS n FROM stop_times_a
  GROUP BY 1)""")

ORACLE["time_histogram"] = v.sql(
    "SELECT length(departure_time)::INTEGER AS length, count(*) AS calls FROM stop_times_a GROUP BY 1")

ORACLE["service_day_instant"] = v.sql(f"""
SELECT feed_id, service_date, s AS day_start, {v.local_iso('s', 'zone')} AS day_start_local,
  {v.local_iso('s + 93600', 'zone')} AS t26_local
FROM (SELECT DISTINCT feed_id, service_date, zone, {v.noon_start('service_date', 'zone')} AS s
  FROM services JOIN zones USING (feed_id))""")

ORACLE["service_calendar"] = v.sql(
    "SELECT feed_id, service_id, service_date, origin FROM services")

ORACLE["candidate_service_dates"] = v.sql(f"""
SELECT query_id, unnest(generate_series({v.wall('at_epoch', 'zone')}::DATE - 2,
  {v.wall('at_epoch + window_minutes * 60', 'zone')}::DATE, INTERVAL 1 DAY))::DATE AS service_date
FROM board_queries JOIN zones USING (feed_id)""")

ORACLE["service_day_candidates"] = v.sql(f"""
SELECT query_id, service_date, day_start, s AS gtfs_seconds,
  CASE WHEN s BETWEEN 0 AND 172799 THEN {v.clock('s')} END AS gtfs_time,
  s BETWEEN 0 AND 107999 AS plausible, s >= 86400 AS after_midnight
FROM (SELECT *, (at_epoch - day_start)::INTEGER AS s FROM (
  SELECT query_id, at_epoch, service_date, {v.noon_start('service_date', 'zone')} AS day_start FROM (
    SELECT query_id, at_epoch, zone, unnest([{v.wall('at_epoch', 'zone')}::DATE - 1,
      {v.wall('at_epoch', 'zone')}::DATE])::DATE AS service_date
    FROM board_queries JOIN zones USING (feed_id))))""")

ORACLE["late_night"] = v.sql(f"""
SELECT feed_id, trip_id, stop_id, departure_time, route_id, service_id, total_calls,
  distinct_trips, {v.clock('mx')} AS max_time
FROM (SELECT c.feed_id, c.trip_id, stop_id, departure_time,
    t.route_id, t.service_id, count(*) OVER (PARTITION BY c.feed_id) AS total_calls,
    max(seconds) OVER (PARTITION BY c.feed_id) AS mx
  FROM (SELECT *, {v.seconds('departure_time')} AS seconds FROM stop_times_a) c
  JOIN trips_a t ON t.feed_id = c.feed_id AND t.trip_id = c.trip_id WHERE seconds >= 86400)
JOIN (SELECT c.feed_id, count(DISTINCT c.trip_id) AS distinct_trips FROM stop_times_a c
  JOIN trips_a t ON t.feed_id = c.feed_id AND t.trip_id = c.trip_id
  WHERE {v.seconds('departure_time')} >= 86400 GROUP BY 1) USING (feed_id)""")

ORACLE["feed_coverage"] = v.sql(f"""
SELECT feed_id, today, service_start, service_end, (service_end - today)::INTEGER AS days_remaining,
  service_end < today AS expired, service_end - today < 7 AS warn, feed_version
FROM (SELECT DISTINCT feed_id, {v.wall('at_epoch', 'zone')}::DATE AS today FROM board_queries
  JOIN zones USING (feed_id))
JOIN (SELECT feed_id, min(lo) AS service_start, max(hi) AS service_end FROM (
  SELECT feed_id, {v.ymd('start_date')} AS lo, {v.ymd('end_date')} AS hi FROM calendar_a UNION ALL
  SELECT feed_id, {v.ymd('date')}, {v.ymd('date')} FROM calendar_dates_a) GROUP BY 1) USING (feed_id)
JOIN (SELECT feed_id, feed_version FROM feed_info_a) USING (feed_id)""")

ORACLE["stop_resolve_join"] = v.sql("""
SELECT n.feed_id, n.needle, r.stop_id, r.matched_by, r.ambiguous,
  CASE WHEN r.stop_id IS NULL THEN 'STOP_NOT_FOUND' ELSE 'FOUND' END AS status
FROM needles n LEFT JOIN resolved r ON r.feed_id = n.feed_id AND r.needle = n.needle""")

_CALLS = ("SELECT feed_id, trip_id, stop_id, stop_sequence, departure_time, seconds, route_id, "
          "service_id, trip_headsign, direction_id, route_short_name, route_type FROM ")
ORACLE["calls_join"] = v.sql(_CALLS + "calls")

v.VIEWS["calls_left_a"] = v.VIEWS["calls"].replace("JOIN routes_a", "LEFT JOIN routes_a")
v.VIEWS["calls_left_a"] = v.VIEWS["calls_left_a"].replace("r.route_short_name", "r.route_short_name")
v.VIEWS["calls_left_b"] = v.VIEWS["calls_left_a"].replace("_a ", "_b ")
ORACLE["calls_left_join"] = v.sql(_CALLS + "calls_left_b")

ORACLE["serving_join"] = v.sql("""
SELECT DISTINCT feed_id, stop_id, route_id, CASE WHEN route_short_name <> '' THEN route_short_name
  ELSE route_id END AS badge
FROM stop_times_a JOIN trips_a USING (feed_id, trip_id) JOIN routes_a USING (feed_id, route_id)""")

ORACLE["window_range_join"] = v.sql("""
SELECT query_id, count(*) AS n, min(departure_epoch) AS first, max(departure_epoch) AS last
FROM board_hits GROUP BY 1""")

ORACLE["presence_joins"] = v.sql("""
SELECT feed_id, stop_id, CASE WHEN a.stop_code IS NULL THEN 'added' WHEN b.stop_code IS NULL
  THEN 'removed' ELSE 'common' END AS side
FROM stops_a a FULL JOIN stops_b b USING (feed_id, stop_id)""")

ORACLE["network_departures"] = v.sql("""
SELECT feed_id, service_date, stop_id, stop_sequence, trip_id, route_id, route_short_name,
  CASE WHEN stop_headsign <> '' THEN stop_headsign ELSE trip_headsign END AS headsign, direction_id,
  service_id, seconds, departure_epoch, seconds >= 86400 AS after_midnight
FROM events_on_days JOIN board_dates USING (feed_id, service_date)""")

ORACLE["explain_empty"] = v.sql(f"""
SELECT feed_id, query_id, needle, matched_by, platforms, services, calls, today,
  CASE WHEN platforms = 0 THEN 'STOP_NOT_FOUND' WHEN local_date > feed_end THEN 'FEED_EXPIRED'
    WHEN services = 0 THEN 'NO_SERVICE_THAT_DAY' WHEN calls = 0 THEN 'STOP_NEVER_SERVED'
    WHEN today = 0 THEN 'NO_SERVICE_AT_STOP_TODAY' ELSE 'WINDOW_TOO_NARROW' END AS verdict
FROM (
  SELECT q.feed_id, q.query_id, q.needle, f.matched_by, q.local_date, i.feed_end,
    coalesce(f.platforms, 0) AS platforms, coalesce(a.n, 0) AS services,
    coalesce(f.calls, 0)::BIGINT AS calls, coalesce(t.n, 0) AS today
  FROM (SELECT q.*, zone, {v.wall('at_epoch', 'zone')}::DATE AS local_date FROM board_queries q
        JOIN zones z ON z.feed_id = q.feed_id) q
  LEFT JOIN (SELECT r.feed_id, r.needle, min(r.matched_by) AS matched_by, count(*) AS platforms,
      sum(n) AS calls FROM resolved r LEFT JOIN (SELECT feed_id, stop_id, count(*) AS n
        FROM stop_times_a GROUP BY ALL) s ON s.feed_id = r.feed_id AND s.stop_id = r.stop_id
      GROUP BY ALL) f ON f.feed_id = q.feed_id AND f.needle = q.needle
  LEFT JOIN (SELECT feed_id, {v.ymd('feed_end_date')} AS feed_end FROM feed_info_a) i
    ON i.feed_id = q.feed_id
  LEFT JOIN (SELECT feed_id, service_date, count(*) AS n FROM services GROUP BY ALL) a
    ON a.feed_id = q.feed_id AND a.service_date = q.local_date
  LEFT JOIN (
    SELECT w.feed_id, w.needle, w.local_date, count(*) AS n FROM (
      SELECT DISTINCT q.feed_id, q.needle, zone, {v.wall('at_epoch', 'zone')}::DATE AS local_date
      FROM board_queries q JOIN zones z ON z.feed_id = q.feed_id) w
    JOIN resolved r ON r.feed_id = w.feed_id AND r.needle = w.needle
    JOIN events_on_days e ON e.feed_id = w.feed_id AND e.stop_id = r.stop_id
      AND e.service_date BETWEEN w.local_date - 2 AND w.local_date + 1
    WHERE e.departure_epoch BETWEEN {v.midnight('w.local_date', 'w.zone')}
      AND {v.midnight('w.local_date + 1', 'w.zone')}
    GROUP BY ALL) t ON t.feed_id = q.feed_id AND t.needle = q.needle AND t.local_date = q.local_date
)""")

_COLS = {
    "agency": ["agency_id", "agency_name", "agency_timezone"],
    "calendar": v.demo.CALENDAR_COLUMNS,
    "calendar_dates": ["service_id", "date", "exception_type"],
    "feed_info": ["feed_publisher_name", "feed_start_date", "feed_end_date", "feed_version"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type", "route_color"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence",
                   "pickup_type", "drop_off_type", "stop_headsign"],
    "stops": ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "location_type",
              "parent_station", "wheelchair_boarding"],
    "trips": ["trip_id", "route_id", "service_id", "trip_headsign", "direction_id", "shape_id"],
}
v.VIEWS["column_values"] = " UNION ALL ".join(
    f"SELECT feed_id, snapshot_id, '{t}' AS table_name, '{c}' AS column_name, {c} AS value, "
    f"count(*) AS n FROM {t}_a GROUP BY ALL" for t, cs in _COLS.items() for c in cs)
v.VIEWS["profile"] = """
SELECT feed_id, snapshot_id, table_name, column_name, sum(n)::BIGINT AS rows,
  sum(CASE WHEN value <> '' THEN n ELSE 0 END)::BIGINT AS non_empty, count(*) AS "distinct",
  sum(length(value) * n)::BIGINT AS text_bytes,
  coalesce(min(value) FILTER (value <> ''), '') AS first_value,
  coalesce(max(value) FILTER (value <> ''), '') AS last_value
FROM column_values GROUP BY ALL"""

ORACLE["feed_profile"] = v.sql("""
SELECT feed_id, snapshot_id, table_name, column_name, rows, non_empty,
  round(1 - non_empty / rows, 4) AS null_rate, "distinct", text_bytes, non_empty = 0 AS always_empty,
  first_value, last_value FROM profile""")

ORACLE["feed_features"] = v.sql("""
SELECT feed_id, 'A' AS snapshot_id, feature,
  CASE WHEN t.rows IS NULL THEN false WHEN col = '' THEN t.rows > 0
    ELSE coalesce(p.non_empty > 0, false) END AS present,
  CASE WHEN t.rows IS NULL THEN f.table_name || '.txt absent' WHEN col = '' THEN t.rows || ' rows'
    WHEN p.non_empty IS NULL THEN 'column ' || col || ' absent'
    ELSE p.non_empty || ' non-empty values' END AS reason
FROM zones z CROSS JOIN (VALUES """ + ", ".join(
    str(x) for x in profile.FEATURES) + """) AS f(feature, table_name, col)
LEFT JOIN (SELECT feed_id, table_name, max(rows) AS rows FROM profile GROUP BY ALL) t
  USING (feed_id, table_name)
LEFT JOIN (SELECT feed_id, table_name, column_name AS col, non_empty FROM profile) p
  USING (feed_id, table_name, col)""")

ORACLE["feed_absent_files"] = v.sql(f"""
SELECT feed_id, snapshot_id, table_name FROM zones, (SELECT unnest({profile.OPTIONAL_FILES})
  AS table_name) WHERE table_name NOT IN ({', '.join(repr(t) for t in _T['a'])})""")

ORACLE["feed_stats"] = v.sql(f"""
SELECT feed_id, snapshot_id, CASE table_name WHEN 'agency' THEN 'agencies'
  WHEN 'calendar' THEN 'calendar_rows' WHEN 'calendar_dates' THEN 'calendar_dates_rows'
  ELSE table_name END AS metric, n AS value FROM ({_counts('a')}) WHERE table_name <> 'feed_info'
UNION ALL SELECT feed_id, snapshot_id, 'routes: ' || {_TYPE_NAME.format('route_type')}, count(*)
  FROM routes_a GROUP BY ALL
UNION ALL SELECT feed_id, snapshot_id, 'service_ids', count(DISTINCT service_id) FROM trips_a
  GROUP BY ALL""")

ORACLE["entity_summary"] = v.sql(f"""
SELECT feed_id, route_id, direction_id, count(DISTINCT trip_id) AS trips,
  count(DISTINCT trip_headsign) AS headsigns, min(trip_headsign) AS first_headsign,
  max(trip_headsign) AS last_headsign,
  {v.clock('min(s)')} AS first_departure, {v.clock('max(s)')} AS last_departure
FROM trips_a LEFT JOIN (SELECT feed_id, trip_id, {v.seconds('departure_time')} AS s
  FROM stop_times_a WHERE departure_time <> '') USING (feed_id, trip_id)
GROUP BY feed_id, route_id, direction_id""")

ORACLE["route_services"] = v.sql(
    "SELECT feed_id, route_id, service_id, count(*) AS trips FROM trips_a GROUP BY ALL")

ORACLE["stop_detail"] = v.sql("""
SELECT s.feed_id, s.stop_id, stop_code, stop_name, coalesce(c.n, 0) AS calls,
  coalesce(r.n, 0) AS routes, coalesce(r.ids, '') AS route_ids
FROM stops_a s
LEFT JOIN (SELECT feed_id, stop_id, count(*) AS n FROM stop_times_a GROUP BY ALL) c
  ON c.feed_id = s.feed_id AND c.stop_id = s.stop_id
LEFT JOIN (SELECT feed_id, stop_id, count(DISTINCT route_id) AS n,
    array_to_string(list_sort(list_distinct(list(route_id))), '|') AS ids
  FROM stop_times_a JOIN trips_a USING (feed_id, trip_id) JOIN routes_a USING (feed_id, route_id)
  GROUP BY ALL) r ON r.feed_id = s.feed_id AND r.stop_id = s.stop_id""")

ORACLE["sign_number"] = v.sql("""
SELECT *, CASE WHEN max(CASE WHEN field = 'stop_code' THEN coverage END) OVER w > 0.9
    AND bool_or(field = 'stop_code' AND is_unique) OVER w THEN 'stop_code'
  WHEN sum(CASE WHEN field = 'stop_code' THEN example_hits END) OVER w > 0 THEN 'stop_code'
  WHEN sum(CASE WHEN field = 'stop_id' THEN example_hits END) OVER w > 0 THEN 'stop_id'
  ELSE 'unknown' END AS verdict
FROM (
  SELECT feed_id, field, count(*) AS total, count(*) FILTER (value <> '') AS non_empty,
    round(count(*) FILTER (value <> '') / count(*), 4) AS coverage,
    count(DISTINCT value) AS "distinct",
    count(DISTINCT value) = count(*) FILTER (value <> '') AS is_unique,
    round(count(*) FILTER (regexp_full_match(value, '[0-9]+')) / count(*) FILTER (value <> ''), 4)
      AS numeric_share,
    coalesce(array_to_string(list_sort(list_distinct(list(length(value))
      FILTER (regexp_full_match(value, '[0-9]+')))), '|'), '') AS lengths,
    count(*) FILTER (value = '10042') AS example_hits
  FROM (SELECT feed_id, 'stop_code' AS field, stop_code AS value FROM stops_a UNION ALL
        SELECT feed_id, 'stop_id', stop_id FROM stops_a) GROUP BY 1, 2)
WINDOW w AS (PARTITION BY feed_id)""")

# ------------------------------------------------------------------------ diffs --
_DIFF_FILES = """
SELECT feed_id, table_name, rows_a, rows_b, rows_b - rows_a AS delta,
  round((rows_b - rows_a) / nullif(rows_a, 0), 4) AS pct_change,
  CASE WHEN rows_a IS NULL THEN 'added' WHEN rows_b IS NULL THEN 'removed'
    WHEN rows_a = rows_b THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT feed_id, table_name, n AS rows_a FROM ({a})) FULL JOIN
     (SELECT feed_id, table_name, n AS rows_b FROM ({b})) USING (feed_id, table_name)"""

ORACLE["diff_files"] = v.sql(_DIFF_FILES.format(
    a=_counts("a"), b=_counts("b", [t for t in _T["a"] if t != "feed_info"])
    + " UNION ALL SELECT feed_id, snapshot_id, 'shapes', count(*) FROM stops_b GROUP BY ALL"))

v.VIEWS["route_pairs"] = """
SELECT feed_id, route_id, a.route_id IS NULL AS no_a, b.route_id IS NULL AS no_b,
  [{'f': 'route_short_name', 'a': a.route_short_name, 'b': b.route_short_name},
   {'f': 'route_long_name', 'a': a.route_long_name, 'b': b.route_long_name},
   {'f': 'route_type', 'a': a.route_type, 'b': b.route_type}] AS fs,
  coalesce(b.route_type, a.route_type) AS route_type
FROM routes_a a FULL JOIN routes_b b USING (feed_id, route_id)"""

v.VIEWS["d_routes"] = """
SELECT feed_id, route_id, CASE WHEN no_a THEN 'added' ELSE 'removed' END AS change, route_type,
  false AS type_changed, '' AS field, '' AS value_a, '' AS value_b
FROM route_pairs WHERE no_a OR no_b
UNION ALL
SELECT feed_id, route_id, 'changed', route_type, list_contains([x.f FOR x IN fs IF x.a <> x.b],
  'route_type'), f.f, f.a, f.b
FROM (SELECT *, unnest(fs) AS f FROM route_pairs WHERE NOT no_a AND NOT no_b) WHERE f.a <> f.b"""
ORACLE["diff_routes"] = v.sql("SELECT * FROM d_routes")

v.VIEWS["d_stops"] = """
SELECT feed_id, stop_id, change, coalesce(cb, ca) AS stop_code, coalesce(na, '') AS name_a,
  coalesce(nb, '') AS name_b, CASE WHEN change = 'moved' THEN round(m, 1) END AS moved_m
FROM (SELECT *, unnest(list_filter([CASE WHEN na IS NULL THEN 'added' WHEN nb IS NULL THEN 'removed'
      END, CASE WHEN na <> nb THEN 'renamed' END,
      CASE WHEN na IS NOT NULL AND nb IS NOT NULL AND (lat1 IS NULL OR lon1 IS NULL OR lat2 IS NULL
        OR lon2 IS NULL) THEN 'coordinates_missing' END,
      CASE WHEN m > 25 THEN 'moved' END], lambda x: x IS NOT NULL)) AS change
  FROM (SELECT *, 2 * 6371008.8 * asin(sqrt((pow(sin((radians(lat2) - radians(lat1)) / 2), 2)
      + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) AS m
    FROM (SELECT feed_id, stop_id, a.stop_code AS ca, b.stop_code AS cb, a.stop_name AS na,
      b.stop_name AS nb, try_cast(a.stop_lat AS DOUBLE) AS lat1, try_cast(a.stop_lon AS DOUBLE) AS lon1,
      try_cast(b.stop_lat AS DOUBLE) AS lat2, try_cast(b.stop_lon AS DOUBLE) AS lon2
      FROM stops_a a FULL JOIN stops_b b USING (feed_id, stop_id))))"""
ORACLE["diff_stops"] = v.sql("SELECT * FROM d_stops")

_SURVIVAL_COLS = []
for _f, _p in (("stop_id", "id"), ("stop_code", "code")):
    _SURVIVAL_COLS += [
        f"count(*) FILTER (f = '{_f}' AND ina) AS {_p}_in_a",
        f"count(*) FILTER (f = '{_f}' AND inb) AS {_p}_in_b",
        f"count(*) FILTER (f = '{_f}' AND ina AND inb) AS {_p}_survived",
        f"count(*) FILTER (f = '{_f}' AND ina AND NOT inb) AS {_p}_lost",
        f"count(*) FILTER (f = '{_f}' AND inb AND NOT ina) AS {_p}_gained"]
v.VIEWS["d_survival"] = f"""
SELECT *, least(id_rate, code_rate) AS worst_rate, least(id_rate, code_rate) IS NOT NULL AS measured,
  coalesce(least(id_rate, code_rate) >= 0.98, false) AS meets_floor
FROM (SELECT *, round(id_survived / nullif(id_in_a, 0), 4) AS id_rate,
    round(code_survived / nullif(code_in_a, 0), 4) AS code_rate
  FROM (SELECT feed_id, {', '.join(_SURVIVAL_COLS)} FROM (
    SELECT feed_id, f, value, bool_or(side = 'a') AS ina, bool_or(side = 'b') AS inb FROM (
      SELECT feed_id, 'stop_id' AS f, stop_id AS value, 'a' AS side FROM stops_a UNION ALL
      SELECT feed_id, 'stop_code', stop_code, 'a' FROM stops_a UNION ALL
      SELECT feed_id, 'stop_id', stop_id, 'b' FROM stops_b UNION ALL
      SELECT feed_id, 'stop_code', stop_code, 'b' FROM stops_b) WHERE value <> '' GROUP BY ALL)
    GROUP BY 1))"""
ORACLE["id_survival"] = v.sql("SELECT * FROM d_survival")


def _span(side):
    return f"""(SELECT feed_id, min(lo) AS start_{side}, max(hi) AS end_{side} FROM (
  SELECT feed_id, {v.ymd('start_date')} AS lo, {v.ymd('end_date')} AS hi FROM calendar_{side}
  UNION ALL SELECT feed_id, {v.ymd('date')}, {v.ymd('date')} FROM calendar_dates_{side}) GROUP BY 1)"""


v.VIEWS["d_shift"] = f"""SELECT *, (start_b - start_a)::INTEGER AS start_shift,
  (end_b - end_a)::INTEGER AS end_shift FROM {_span('a')} FULL JOIN {_span('b')} USING (feed_id)"""

_IDS = ("(SELECT DISTINCT feed_id, service_id, 1 AS p{0} FROM (SELECT feed_id, service_id FROM "
        "calendar_{0} UNION ALL SELECT feed_id, service_id FROM calendar_dates_{0}))")
_FS = ", ".join(f"{{'f': '{f}', 'a': a.{f}, 'b': b.{f}}}" for f in v.demo.CALENDAR_COLUMNS[1:])
v.VIEWS["d_calendar"] = f"""
SELECT feed_id, CASE WHEN pa IS NULL THEN 'service_added' ELSE 'service_removed' END AS change,
  service_id, '' AS field, '' AS value_a, '' AS value_b
FROM {_IDS.format('a')} FULL JOIN {_IDS.format('b')} USING (feed_id, service_id)
WHERE pa IS NULL OR pb IS NULL
UNION ALL
SELECT feed_id, 'field_changed', service_id, f.f, f.a, f.b FROM (
  SELECT feed_id, service_id, unnest([{_FS}]) AS f FROM calendar_a a JOIN calendar_b b
  USING (feed_id, service_id)) WHERE f.a <> f.b
UNION ALL
SELECT feed_id, 'exception_removed', service_id, date, exception_type, '' FROM (
  SELECT feed_id, service_id, date, exception_type FROM calendar_dates_a EXCEPT
  SELECT feed_id, service_id, date, exception_type FROM calendar_dates_b)
UNION ALL
SELECT feed_id, 'exception_added', service_id, date, exception_type, '' FROM (
  SELECT feed_id, service_id, date, exception_type FROM calendar_dates_b EXCEPT
  SELECT feed_id, service_id, date, exception_type FROM calendar_dates_a)
UNION ALL
SELECT feed_id, 'window_shift', '', 'end', end_a::VARCHAR, end_b::VARCHAR FROM d_shift
  WHERE end_a IS DISTINCT FROM end_b
UNION ALL
SELECT feed_id, 'window_shift', '', 'start', start_a::VARCHAR, start_b::VARCHAR FROM d_shift
  WHERE start_a IS DISTINCT FROM start_b"""
ORACLE["diff_calendar"] = v.sql("SELECT * FROM d_calendar")


def _bag(side_a: str, side_b: str, keys: str, fields: list[str]) -> str:
    rec = "{'t': trip_id, " + ", ".join(f"'{f}': {f}" for f in fields) + "}"
    changed = ", ".join(f"CASE WHEN a.{f} <> b.{f} THEN '{f}' END" for f in fields)
    return f"""
SELECT {keys}, greatest(n_b - n_a, 0) AS added, greatest(n_a - n_b, 0) AS removed, changed_fields,
  {', '.join(f'coalesce(b.{f}, a.{f}) AS {f}' for f in fields)}
FROM (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN '' ELSE concat_ws(',', {changed}) END
    AS changed_fields
  FROM (SELECT {keys}, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b,
      min({rec}) FILTER (side = 'a') AS a, min({rec}) FILTER (side = 'b') AS b
    FROM (SELECT *, 'a' AS side FROM ({side_a}) UNION ALL BY NAME
          SELECT *, 'b' AS side FROM ({side_b})) GROUP BY {keys}))
WHERE n_a <> n_b OR changed_fields <> ''"""


_CALL_SIDE = ("SELECT feed_id, stop_id, departure_time, route_id, direction_id, trip_id, "
              "trip_headsign AS headsign, CASE WHEN pickup_type = '' THEN '0' ELSE pickup_type END "
              "AS pickup_type FROM calls_left_{0}")
ORACLE["diff_schedule"] = v.sql(_bag(
    _CALL_SIDE.format("a"), _CALL_SIDE.format("b"),
    "feed_id, stop_id, departure_time, route_id, direction_id", ["headsign", "pickup_type"]))

_TRIP_SIDE = ("SELECT feed_id, route_id, direction_id, trip_id, trip_headsign AS headsign, "
              + v.clock("min(seconds)") + " AS first_departure, " + v.clock("max(seconds)")
              + " AS last_departure, count(*)::VARCHAR AS calls FROM calls_left_{0} "
              "WHERE seconds IS NOT NULL "
              "GROUP BY feed_id, route_id, direction_id, trip_id, trip_headsign, service_id")
ORACLE["diff_route_schedule"] = v.sql(_bag(
    _TRIP_SIDE.format("a"), _TRIP_SIDE.format("b"),
    "feed_id, route_id, direction_id, first_departure", ["headsign", "last_departure", "calls"]))

v.VIEWS["d_files"] = _DIFF_FILES.format(a=_counts("a"), b=_counts("b"))
_R = {k: f"count(DISTINCT CASE WHEN {c} THEN route_id END)" for k, c in {
    "removed": "change = 'removed'", "added": "change = 'added'", "changed": "change = 'changed'",
    "rail": "change = 'removed' AND trim(route_type) IN ('0','1','2','5','7','12')",
    "retyped": "type_changed"}.items()}
v.VIEWS["d_findings"] = f"""
SELECT feed_id, CASE WHEN meets_floor THEN 'routine' ELSE 'alarming' END AS severity,
  'stop_ids' AS dimension, CASE WHEN meets_floor THEN '' WHEN measured
    THEN 'below the survival floor: ' END || code_lost || ' code(s) and ' || id_lost
    || ' id(s) retired' AS detail
FROM d_survival WHERE NOT meets_floor OR code_lost > 0 OR id_lost > 0
UNION ALL SELECT feed_id, CASE WHEN status = 'removed' AND table_name IN ('stops','trips',
    'stop_times','calendar') THEN 'alarming' ELSE 'notable' END, 'files',
  table_name || CASE status WHEN 'added' THEN '.txt appeared (' || rows_b || ' rows)'
    ELSE '.txt disappeared (was ' || rows_a || ' rows)' END
  FROM d_files WHERE status IN ('added', 'removed')
UNION ALL SELECT feed_id, 'alarming', 'routes', {_R['rail']} || ' rail route(s) removed'
  FROM d_routes GROUP BY 1 HAVING {_R['rail']} > 0
UNION ALL SELECT feed_id, 'notable', 'routes', {_R['removed']} || ' route(s) removed'
  FROM d_routes GROUP BY 1 HAVING {_R['rail']} = 0 AND {_R['removed']} > 0
UNION ALL SELECT feed_id, 'notable', 'routes', {_R['added']} || ' route(s) added'
  FROM d_routes GROUP BY 1 HAVING {_R['added']} > 0
UNION ALL SELECT feed_id, 'alarming', 'routes', {_R['retyped']} || ' route(s) changed type'
  FROM d_routes GROUP BY 1 HAVING {_R['retyped']} > 0
UNION ALL SELECT feed_id, 'routine', 'routes', {_R['changed']} || ' route(s) renamed'
  FROM d_routes GROUP BY 1 HAVING {_R['retyped']} = 0 AND {_R['changed']} > 0
UNION ALL SELECT feed_id, CASE WHEN round(count(*) / any_value(id_survived), 4) > 0.01 THEN 'notable'
    ELSE 'routine' END, 'stops', count(*) || ' stop(s) moved; furthest '
    || round(max(moved_m))::INTEGER || ' m'
  FROM d_stops JOIN d_survival USING (feed_id) WHERE change = 'moved' GROUP BY 1
UNION ALL SELECT feed_id, CASE WHEN end_shift > 0 THEN 'routine' ELSE 'alarming' END, 'calendar',
    'service ends ' || abs(end_shift) || ' day(s) ' || CASE WHEN end_shift > 0 THEN 'later'
    ELSE 'earlier' END FROM d_shift WHERE end_shift <> 0
UNION ALL SELECT feed_id, 'routine', 'calendar', count(*) FILTER (change = 'service_removed')
    || ' service id(s) removed, ' || count(*) FILTER (change = 'service_added') || ' added'
  FROM d_calendar GROUP BY 1 HAVING count(*) FILTER (change IN ('service_removed',
    'service_added')) > 0"""
ORACLE["diff_findings"] = v.sql("""
SELECT *, CASE severity WHEN 'alarming' THEN 0 WHEN 'notable' THEN 1 WHEN 'opportunity' THEN 2
  ELSE 3 END AS severity_rank FROM d_findings""")

# --------------------------------------------------------------------- realtime --
v.VIEWS["updates"] = """
SELECT 'F' || (event_id * 2 % 3) AS feed_id, 'C' || (seen // 86400) AS capture_id,
  event_id AS entity_pos, 'T' || event_id * 2 AS trip_id, seen AS seen_epoch, event_type, value,
  trunc(value * 10)::INTEGER - 240 AS delay
FROM (SELECT *, floor(epoch(ts))::BIGINT + 1009 * 86400 AS seen FROM events)"""

v.VIEWS["trip_updates"] = """
SELECT feed_id, capture_id, entity_pos, trip_id,
  CASE WHEN event_type = 'view' AND entity_pos % 2 = 0 THEN '20261101' ELSE '' END AS start_date,
  CASE WHEN event_type = 'signup' THEN 'CANCELED' ELSE 'SCHEDULED' END AS trip_relationship,
  CASE WHEN event_type IN ('view', 'signup') THEN delay END AS trip_delay FROM updates"""

v.VIEWS["stop_updates"] = f"""
SELECT feed_id, capture_id, entity_pos, pos AS stu_pos, trip_id,
  CASE WHEN (entity_pos + pos) % 3 = 1 THEN '' ELSE stop_id END AS stop_id,
  CASE WHEN (entity_pos + pos) % 3 = 0 THEN '' ELSE stop_sequence END AS stop_sequence,
  CASE WHEN event_type = 'error' AND pos % 2 = 0 THEN 'SKIPPED' ELSE 'SCHEDULED' END AS relationship,
  (CASE WHEN entity_pos % 5 <> 4 THEN CASE WHEN entity_pos % 50 = 3 THEN 90000
    ELSE delay + 30 * pos END END)::INTEGER AS event_delay,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 300 THEN 9000000000 ELSE
    CASE feed_id WHEN 'F0' THEN 1793512800 WHEN 'F1' THEN 1793509200 ELSE 1793516400 END
      + seconds + delay END END AS event_time, seen_epoch
FROM updates JOIN (SELECT *, (row_number() OVER (PARTITION BY feed_id, trip_id
    ORDER BY stop_sequence, stop_id) - 1)::INTEGER AS pos
  FROM (SELECT DISTINCT feed_id, trip_id, stop_id, stop_sequence,
      {v.seconds('departure_time')} AS seconds FROM stop_times_a) WHERE seconds IS NOT NULL)
  USING (feed_id, trip_id) WHERE event_type <> 'view'"""

v.VIEWS["captures"] = """SELECT feed_id, capture_id, max(seen_epoch) AS fetched_epoch,
  count(*) AS entities FROM updates GROUP BY 1, 2"""

v.VIEWS["headers"] = """
SELECT 'F' || (event_id % 3) AS feed_id, 'H' || event_id AS capture_id, ts,
  CASE event_type WHEN 'click' THEN 'trip_updates' WHEN 'view' THEN 'vehicle_positions'
    ELSE 'alerts' END AS entity_kind, t AS fetched_epoch, t - k * 5 AS header_ts,
  1000 + k AS bytes, k % 7 AS entities
FROM (SELECT *, floor(epoch(ts))::BIGINT AS t, json_extract_string(props, '$.k')::BIGINT AS k
  FROM events)"""

v.VIEWS["field_paths"] = """
SELECT feed_id, capture_id, c.p AS path, c.w AS wire_type FROM (
  SELECT 'F' || (event_id % 3) AS feed_id, 'H' || event_id AS capture_id, unnest(list_filter([
    {'p': 'header', 'w': 'length-delimited'}, {'p': 'header.timestamp', 'w': 'varint'},
    {'p': 'entity', 'w': 'length-delimited'},
    CASE WHEN event_type <> 'view' THEN {'p': 'entity.trip_update', 'w': 'length-delimited'} END,
    CASE WHEN event_type = 'signup' THEN {'p': 'entity.trip_update.delay', 'w': 'varint'} END,
    CASE WHEN event_type = 'signup' AND event_id % 11 = 3
      THEN {'p': 'entity.trip_update.delay', 'w': 'fixed32'} END,
    CASE WHEN event_id % 11 = 0 THEN {'p': 'entity.?7', 'w': 'varint'} END],
    lambda x: x IS NOT NULL)) AS c FROM events)"""

v.VIEWS["census"] = """
SELECT feed_id, path, count(DISTINCT capture_id) AS present,
  round(count(DISTINCT capture_id) / any_value(n), 4) AS presence_rate,
  array_to_string(list_sort(list_distinct(list(wire_type))), '|') AS wire_types,
  NOT contains(path, '?') AS modelled
FROM field_paths JOIN (SELECT feed_id, count(*) AS n FROM headers GROUP BY 1) USING (feed_id)
GROUP BY feed_id, path"""
ORACLE["rt_field_census"] = v.sql("SELECT * FROM census")

v.VIEWS["health"] = """
SELECT z.feed_id, entity_kind, h.capture_id IS NOT NULL AS available, h.capture_id, h.header_ts,
  as_of - h.header_ts AS age_seconds, h.fetched_epoch - h.header_ts AS age_at_fetch,
  as_of - h.fetched_epoch AS fetched_ago, coalesce(as_of - h.header_ts > 300, false) AS stale, h.bytes,
  h.entities, max(h.header_ts) OVER (PARTITION BY z.feed_id)
    - min(h.header_ts) OVER (PARTITION BY z.feed_id) AS header_spread
FROM (SELECT feed_id, max(fetched_epoch) + 60 AS as_of FROM headers GROUP BY 1) z
CROSS JOIN (SELECT unnest(['trip_updates', 'vehicle_positions', 'alerts', 'shapes']) AS entity_kind)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY feed_id, entity_kind
    ORDER BY fetched_epoch DESC, capture_id DESC) AS rn FROM headers) h
  USING (feed_id, entity_kind) WHERE rn = 1 OR rn IS NULL"""
ORACLE["rt_feed_health"] = v.sql("SELECT * FROM health")

v.VIEWS["winners"] = """SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY feed_id, capture_id, trip_id ORDER BY entity_pos DESC) AS rn FROM trip_updates)
  WHERE rn = 1"""
ORACLE["rt_latest_update"] = v.sql(
    "SELECT feed_id, capture_id, trip_id, entity_pos, start_date, trip_relationship, trip_delay "
    "FROM winners")

v.VIEWS["matched_updates"] = """
SELECT query_id, d.feed_id, rank, d.trip_id, d.stop_id, d.stop_sequence, service_date,
  departure_epoch, minutes_away, a.capture_id, headsign, route_id, route_short_name, gtfs_time,
  d.zone, w.trip_id IS NOT NULL AND (w.start_date = '' OR
    w.start_date = strftime(service_date, '%Y%m%d')) AS realtime,
  w.trip_relationship, w.trip_delay, w.entity_pos
FROM departures d
LEFT JOIN (SELECT q.feed_id, q.at_epoch, arg_max(c.capture_id, c.fetched_epoch) AS capture_id
    FROM (SELECT DISTINCT feed_id, at_epoch FROM board_queries) q
    JOIN captures c ON c.feed_id = q.feed_id AND c.fetched_epoch <= q.at_epoch GROUP BY 1, 2) a
  ON a.feed_id = d.feed_id AND a.at_epoch = d.at_epoch
LEFT JOIN winners w ON w.feed_id = d.feed_id AND w.capture_id = a.capture_id
  AND w.trip_id = d.trip_id"""

v.VIEWS["first_stu"] = """
SELECT * FROM (SELECT m.query_id, m.rank, s.relationship, s.event_delay, s.event_time,
    row_number() OVER (PARTITION BY m.query_id, m.rank ORDER BY s.stu_pos) AS rn
  FROM matched_updates m JOIN stop_updates s ON s.feed_id = m.feed_id
    AND s.capture_id = m.capture_id AND s.entity_pos = m.entity_pos
  WHERE m.realtime AND (s.stop_id = m.stop_id OR s.stop_sequence = m.stop_sequence)) WHERE rn = 1"""

v.VIEWS["overlaid"] = """
SELECT *, CASE WHEN live AND ok THEN departure_epoch + derived END AS predicted_epoch,
  CASE WHEN NOT realtime THEN 'SCHEDULED_ONLY' WHEN canceled THEN 'CANCELED'
    WHEN rel = 'SKIPPED' THEN 'SKIPPED' WHEN measured AND NOT ok THEN 'IMPLAUSIBLE_DELAY'
    WHEN measured THEN rel WHEN rel = 'SCHEDULED' THEN 'NO_PREDICTION' ELSE rel END AS status,
  CASE WHEN live THEN coalesce(derived, e) END AS delay_seconds,
  CASE WHEN live AND ok THEN CASE WHEN e IS NOT NULL THEN 'absolute_time' ELSE 'delay' END END
    AS delay_basis,
  CASE WHEN live AND ok THEN (minutes_away + round_even(derived / 60, 0))::INTEGER END
    AS minutes_predicted
FROM (SELECT *, coalesce(abs(derived) <= 43200, false) AS ok,
    realtime AND NOT canceled AND rel <> 'SKIPPED' AND measured AS live
  FROM (SELECT *, e IS NOT NULL OR dl IS NOT NULL AS measured,
      coalesce(trip_relationship = 'CANCELED', false) AS canceled,
      CASE WHEN e IS NULL THEN dl WHEN e BETWEEN -3000000000 AND 6000000000
        THEN e - departure_epoch END AS derived
    FROM (SELECT m.*, f.event_time AS e,
        (CASE WHEN f.rn = 1 THEN f.event_delay ELSE m.trip_delay END)::BIGINT AS dl,
        CASE WHEN f.rn = 1 THEN f.relationship WHEN m.trip_delay IS NOT NULL THEN 'SCHEDULED'
          ELSE 'NO_DATA' END AS rel
      FROM matched_updates m LEFT JOIN first_stu f USING (query_id, rank))))"""
ORACLE["rt_overlay"] = v.sql("""
SELECT query_id, rank, trip_id, stop_id, stop_sequence, service_date, departure_epoch, minutes_away,
  capture_id, realtime, status, delay_seconds, delay_basis, predicted_epoch, minutes_predicted
FROM overlaid""")

ORACLE["rt_match_rate"] = v.sql("""
SELECT query_id, count(*) AS inspected, count(*) FILTER (realtime) AS matched,
  round(count(*) FILTER (realtime) / count(*), 4) AS match_rate FROM overlaid GROUP BY 1""")

v.VIEWS["join_rate"] = """
SELECT feed_id, count(*) AS rt_trips, count(t.trip_id) AS resolved,
  round(count(t.trip_id) / count(*), 4) AS join_rate
FROM (SELECT DISTINCT feed_id, trip_id FROM trip_updates) u
LEFT JOIN (SELECT DISTINCT feed_id, trip_id FROM trips_a) t USING (feed_id, trip_id) GROUP BY 1"""
ORACLE["rt_join_rate"] = v.sql("SELECT * FROM join_rate")

# ----------------------------------------------------------------------- boards --
v.VIEWS["explained"] = ORACLE["explain_empty"][ORACLE["explain_empty"].rindex("\nSELECT feed_id, query_id"):]
ORACLE["expected_board"] = v.sql("""
SELECT query_id, CASE WHEN coalesce(route_short_name, '') <> '' THEN route_short_name
    ELSE route_id END AS route, headsign, coalesce(predicted_epoch, departure_epoch) AS shown_epoch,
  departure_epoch AS scheduled_epoch, predicted_epoch,
  coalesce(minutes_predicted, minutes_away) AS minutes_away, realtime, status, trip_id, stop_id,
  coalesce(c.code, '') AS stop_code, route_id, service_date, gtfs_time, stop_sequence,
  NULL::VARCHAR AS reason, row_number() OVER (PARTITION BY query_id ORDER BY
    coalesce(predicted_epoch, departure_epoch), CASE WHEN coalesce(route_short_name, '') <> ''
    THEN route_short_name ELSE route_id END, trip_id, stop_sequence, stop_id, service_date, headsign)
    ::INTEGER AS position
FROM overlaid LEFT JOIN (
  SELECT q.query_id, min(s.stop_code) AS code FROM board_queries q
  JOIN matches m ON m.feed_id = q.feed_id AND m.needle = q.needle
  JOIN stops_a s ON s.feed_id = m.feed_id AND s.stop_id = m.stop_id
  WHERE s.stop_code <> '' GROUP BY 1 HAVING count(DISTINCT s.stop_code) = 1) c USING (query_id)
UNION ALL BY NAME
SELECT query_id, verdict AS reason FROM explained e WHERE NOT EXISTS (
  SELECT 1 FROM departures d WHERE d.query_id = e.query_id)""")

v.VIEWS["board_e"] = f"""
SELECT feed_id, query_id AS board_id, rank AS position, route_id, route_short_name AS route, headsign,
  {v.local_iso('departure_epoch', 'zone')} AS departure, minutes_away::VARCHAR AS minutes_away,
  'SCHEDULED_ONLY' AS status, 'false' AS realtime, stop_id, service_date::VARCHAR AS service_date,
  substr(trip_id, 2)::BIGINT AS t, substr(stop_id, 2)::BIGINT AS s, departure_epoch, gtfs_time,
  CASE WHEN substr(stop_id, 2)::BIGINT % 2 = 0 THEN trip_id END AS trip_id,
  strftime({v.wall('departure_epoch', 'zone')}, '%H:%M') AS hhmm, zone
FROM departures"""
v.VIEWS["board_o1"] = f"""
SELECT feed_id, board_id, position, t, nullif(CASE WHEN s % 5 = 0 THEN NULL WHEN t % 7 = 0
    THEN route_id ELSE route END, '') AS route,
  CASE WHEN t % 23 = 0 THEN upper(headsign) WHEN t % 29 = 0 THEN 'Depot' ELSE headsign END AS headsign,
  CASE WHEN s % 11 = 0 THEN 'soon' WHEN t % 19 = 0 THEN 'late' WHEN t % 13 = 0 THEN 'gtfs'
    ELSE 'iso' END AS form,
  minutes_away || '.0' AS minutes_away, stop_id, trip_id,
  CASE WHEN s % 11 = 0 THEN NULL WHEN t % 19 = 0
    THEN strftime({v.wall('departure_epoch + 60', 'zone')}, '%H:%M')
    WHEN t % 13 = 0 THEN lpad((split_part(gtfs_time, ':', 1)::INTEGER % 24)::VARCHAR, 2, '0') || ':'
      || split_part(gtfs_time, ':', 2) ELSE hhmm END AS hhmm
FROM board_e WHERE t % 17 <> 0"""
v.VIEWS["board_o"] = """SELECT * FROM board_o1 UNION ALL
SELECT * REPLACE (position + 1000 AS position) FROM board_o1 WHERE t % 31 = 0"""
v.VIEWS["board_modes"] = """
SELECT board_id, CASE WHEN ne > 0 AND no > 0 AND ide AND ido THEN 'trip_id'
  WHEN ne > 0 AND no > 0 AND te AND tou AND re AND ro THEN 'departure_route'
  WHEN te AND tou THEN 'departure' ELSE 'position' END AS mode
FROM (SELECT board_id, count(*) AS ne, count(trip_id) = count(*) AND count(DISTINCT trip_id) = count(*)
    AS ide, count(hhmm) = count(*) AS te, true AS re FROM board_e GROUP BY 1)
LEFT JOIN (SELECT board_id, count(*) AS no, count(trip_id) = count(*) AND count(DISTINCT trip_id)
    = count(*) AS ido, count(hhmm) = count(*) AS tou, count(route) = count(*) AS ro
  FROM board_o GROUP BY 1) USING (board_id)"""
v.VIEWS["board_modes"] = v.VIEWS["board_modes"].replace("AND tou THEN 'departure'",
                                                       "AND coalesce(tou, true) THEN 'departure'")


def _side(table: str, route: str) -> str:
    key = (f"CASE mode WHEN 'trip_id' THEN trip_id WHEN 'departure_route' THEN hhmm || '|' || {route} "
           "WHEN 'departure' THEN hhmm ELSE position::VARCHAR END")
    return (f"(SELECT *, row_number() OVER (PARTITION BY board_id, pair_key ORDER BY position) AS "
            f"occurrence FROM (SELECT *, {key} AS pair_key FROM {table} JOIN board_modes "
            "USING (board_id)))")


def _ck(x: str) -> str:
    text = f"lower(trim({x}::VARCHAR))"
    return f"coalesce(try_cast({text} AS DOUBLE)::VARCHAR, {text})"


_ROUTE_E = "coalesce(nullif(e.route, ''), e.route_id)"
v.VIEWS["board_pairs"] = f"""
SELECT coalesce(e.feed_id, o.feed_id) AS feed_id, coalesce(e.board_id, o.board_id) AS board_id,
  coalesce(e.mode, o.mode) AS mode, coalesce(e.pair_key, o.pair_key) AS pair_key,
  coalesce(e.occurrence, o.occurrence) AS occurrence,
  CASE WHEN e.position IS NULL OR o.position IS NULL THEN '' ELSE concat_ws(',',
    CASE WHEN {_ck(_ROUTE_E)} <> {_ck('o.route')} AND {_ck('e.route_id')} <> {_ck('o.route')}
      THEN 'route' END,
    CASE WHEN {_ck('e.headsign')} <> {_ck('o.headsign')} THEN 'headsign' END,
    CASE WHEN o.form = 'soon' OR e.hhmm <> o.hhmm THEN 'departure' END) END AS differing,
  e.position AS expected_position, o.position AS observed_position
FROM {_side('board_e', _ck("coalesce(nullif(route, ''), route_id)"))} e
FULL JOIN {_side('board_o', _ck('route'))} o
  ON e.board_id = o.board_id AND e.pair_key = o.pair_key AND e.occurrence = o.occurrence"""
v.VIEWS["reconciled"] = """
SELECT feed_id, board_id, mode, pair_key, occurrence, CASE WHEN observed_position IS NULL
    THEN 'missing' WHEN expected_position IS NULL THEN 'extra' WHEN differing <> '' THEN 'differing'
    ELSE 'matched' END AS outcome, differing, expected_position, observed_position FROM board_pairs"""
ORACLE["board_reconcile"] = v.sql("SELECT * FROM reconciled")
ORACLE["board_reconcile_summary"] = v.sql("""
SELECT feed_id, board_id, mode, count(*) FILTER (outcome IN ('matched', 'differing')) AS matched,
  count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'extra') AS extra,
  count(*) FILTER (outcome = 'differing') AS differing,
  count(*) FILTER (outcome <> 'matched') = 0 AS agrees FROM reconciled GROUP BY 1, 2, 3""")

# ------------------------------------------------------------------------ pages --
ORACLE["page_scan"] = ("SELECT page_id, url, octet_length(encode(html))::INTEGER AS bytes, "
                       "sha256(html) AS sha256 FROM pages")

v.VIEWS["page_captures"] = """
SELECT page_id::VARCHAR AS page_key, page_id, url, v AS version,
  1790000000 + page_id + v * 86400 AS fetched_epoch,
  CASE WHEN v = 2 AND page_id % 9 = 0 THEN replace(h, '</article>', '<p>Fares: $2.50 - $5.00 from '
    || 'September 7, 2026</p><p>Bus: Sunday schedule</p><a href="/pdfs/P' || (page_id % 5)
    || '/r.pdf">PDF</a><a href="https://x.example/?pickId=Q' || (page_id % 3)
    || '">next</a></article>') ELSE h END AS html0,
  CASE WHEN page_id % 19 = 4 THEN replace(replace(html0, '<article>', '<article><nav>'), '</article>', '</nav></article>')
    ELSE html0 END AS html1,
  CASE WHEN page_id % 6 = 1 THEN replace(html1, '<article>', '<meta content="NoIndex, noarchive" id="r" name="robots"><article>')
    ELSE html1 END AS html,
  page_id % 13 <> 5 OR v = 1 AS extraction_ok
FROM (SELECT *, replace(html, '<article>', '<article><p>Served 2026-10-0' || v || 'T08:00:00Z by '
    || md5(page_id || '-' || v) || ' style.css?ver=1.' || v || '</p>') AS h
  FROM (SELECT *, unnest(CASE WHEN page_id % 10 = 0 THEN [1] ELSE [1, 2] END) AS v FROM pages))"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _page_text(html: str, chrome: bool) -> str:
    """The text chain in RE2; opaque tokens are found by cutting the text into runs."""
    tags = tx.DROP_TAGS + (tx.CHROME_TAGS if chrome else [])
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    out = f"regexp_replace({out}, {_lit(tx._whole(tags))}, chr(10), 'g')"
    inline = "|".join(tx.INLINE_TAGS)
    out = f"regexp_replace({out}, '(?is)</?(?:{inline})\\b[^>]*>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]+>', chr(10), 'g')"
    for entity, char in tx.ENTITIES:
        out = f"replace({out}, {_lit(entity)}, {_lit(char)})"
    out = f"replace({out}, chr(160), ' ')"
    for code in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        out = f"replace({out}, chr({code}), '')"
    for pattern, mask in tx.NOISE:
        out = f"regexp_replace({out}, {_lit(pattern)}, '{mask}', 'g')"
    run = "[A-Za-z0-9_][A-Za-z0-9_-]*[A-Za-z0-9_]"
    out = (f"array_to_string(list_transform(regexp_extract_all({out}, '(?s){run}|.'), lambda x: "
           "CASE WHEN length(x) >= 24 AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]') "
           "THEN '[nonce]' ELSE x END), '')")
    out = f"regexp_replace({out}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({out}, ' ?(?:\\n ?)+', chr(10), 'g'), ' ' || chr(10))"


v.VIEWS["norm"] = f"""
SELECT *, sha256(text) AS content_hash FROM (SELECT page_key, page_id, version, fetched_epoch, html,
  extraction_ok, 'single_article' || CASE WHEN t = '' THEN '+chrome_kept' ELSE '' END AS strategy,
  CASE WHEN t = '' THEN {_page_text("regexp_extract(html, '(?is)<article\\b.*</article\\s*>')", False)} ELSE t END AS text
  FROM (SELECT *, {_page_text("regexp_extract(html, '(?is)<article\\b.*</article\\s*>')", True)} AS t FROM page_captures))"""

ORACLE["page_normalize"] = v.sql("""
SELECT page_key, version, strategy, content_hash, octet_length(encode(html))::INTEGER AS bytes_raw,
  octet_length(encode(text))::INTEGER AS bytes_text,
  round(octet_length(encode(text)) / octet_length(encode(html)), 4) AS signal_ratio,
  len(string_split_regex(text, '[ \\n]+'))::INTEGER AS word_count,
  len(string_split(text, chr(10)))::INTEGER AS line_count,
  page_id % 6 = 1 AS noarchive, false AS nosnippet, page_id % 6 = 1 AS noindex
FROM norm""")

v.VIEWS["two_captures"] = """
SELECT page_key, max(CASE WHEN rn = 1 THEN content_hash END) AS h1,
  max(CASE WHEN rn = 2 THEN content_hash END) AS h2, max(CASE WHEN rn = 1 THEN text END) AS t1,
  max(CASE WHEN rn = 2 THEN text END) AS t2, bool_or(rn = 1 AND extraction_ok) AS ok,
  max(fetched_epoch) AS last_fetched, max(n) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY fetched_epoch DESC, content_hash DESC) AS rn,
  count(*) OVER (PARTITION BY page_key) AS n FROM norm) GROUP BY 1"""

v.VIEWS["drift"] = """
SELECT page_key, severity, CASE severity WHEN 'alarming' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END
    AS severity_rank,
  CASE WHEN h1 IS NULL THEN 'never_captured' WHEN NOT ok THEN 'extraction_failed'
    WHEN h1 <> h2 THEN 'changed' WHEN h2 IS NULL THEN 'single_capture' ELSE 'unchanged' END AS status,
  coalesce(h1 <> h2, false) AS changed, coalesce(n, 0) AS captures, h1 AS current_hash,
  h2 AS previous_hash, last_fetched
FROM (SELECT page_id::VARCHAR AS page_key, CASE page_id % 4 WHEN 0 THEN 'alarming' WHEN 1
  THEN 'notable' ELSE 'routine' END AS severity FROM pages
  UNION ALL SELECT 'planned-' || page_id, 'notable' FROM pages WHERE page_id % 17 = 3)
LEFT JOIN two_captures USING (page_key)"""
ORACLE["page_drift"] = v.sql("SELECT * FROM drift")

ORACLE["page_line_delta"] = v.sql("""
SELECT page_key, sum(greatest(net, 0))::BIGINT AS lines_added,
  sum(greatest(-net, 0))::BIGINT AS lines_removed
FROM (SELECT page_key, line, sum(s) AS net FROM (
  SELECT page_key, unnest(string_split(t1, chr(10))) AS line, 1 AS s FROM two_captures WHERE h1 <> h2
  UNION ALL SELECT page_key, unnest(string_split(t2, chr(10))), -1 FROM two_captures
    WHERE h1 <> h2) GROUP BY 1, 2) WHERE net <> 0 GROUP BY 1""")

_MONTH = ("lpad((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr({0}, 1, 3))) + 2) // 3"
          "::BIGINT, 2, '0')")


def _month(x: str) -> str:
    return f"lpad(list_position({tx.MONTHS}, lower(substr({x}, 1, 3)))::VARCHAR, 2, '0')"


def _rx(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {_lit(pattern)}, {group})"


def _printed_date(x: str) -> str:
    w, s = tx.DATE_WORDS, tx.DATE_SLASH
    sy = _rx(x, s, 3)
    return f"""CASE WHEN {_rx(x, tx.DATE_ISO, 0)} <> '' THEN {_rx(x, tx.DATE_ISO, 0)}
  WHEN {_rx(x, w, 3)} <> '' THEN {_rx(x, w, 3)} || '-' || {_month(_rx(x, w, 1))} || '-'
    || lpad({_rx(x, w, 2)}, 2, '0')
  WHEN {sy} <> '' THEN CASE WHEN {sy}::INTEGER < 100 THEN ({sy}::INTEGER + 2000)::VARCHAR
    ELSE lpad({sy}, 4, '0') END || '-' || lpad({_rx(x, s, 1)}, 2, '0') || '-'
    || lpad({_rx(x, s, 2)}, 2, '0') END"""


def _service(x: str) -> str:
    whens = " ".join(f"WHEN contains(lower(trim({x})), '{n}') THEN '{t}'" for n, t in tx.SERVICE_TYPES)
    return f"CASE WHEN trim({x}) = '' THEN 'unknown' {whens} ELSE 'unrecognised' END"


def _mode(x: str) -> str:
    bus, rail = (f"regexp_matches({x}, {_lit(p)})" for p in (tx.BUS, tx.RAIL))
    return f"CASE WHEN {rail} AND NOT {bus} THEN 'rail' WHEN {bus} AND NOT {rail} THEN 'bus' END"


v.VIEWS["newest"] = "SELECT page_key, max(version) AS version FROM page_captures GROUP BY 1"
v.VIEWS["facts"] = f"""
SELECT page_key, version, line_no, cents, is_range, date_iso, nullif(phrase, '') AS phrase,
  CASE WHEN phrase <> '' THEN {_service('phrase')} END AS service_type, mode
FROM (SELECT page_key, version, line_no,
    CASE WHEN len(ms) > 0 THEN array_to_string(list_transform(ms, lambda m:
      (regexp_replace(m, '[$, \\t]', '', 'g')::DECIMAL(18,2) * 100)::BIGINT::VARCHAR), '|')
      WHEN regexp_matches(line, {_lit(tx.FREE_CELL)}) THEN '0' END AS cents,
    len(ms) > 1 AS is_range, {_printed_date('line')} AS date_iso,
    lower(regexp_replace(regexp_extract(line, {_lit(tx.SERVICE_PHRASE)}), '\\s+', ' ', 'g')) AS phrase,
    {_mode('line')} AS mode
  FROM (SELECT *, regexp_extract_all(line, {_lit(tx.MONEY)}) AS ms FROM (
    SELECT page_key, version, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INTEGER AS line_no
    FROM (SELECT page_key, version, string_split(text, chr(10)) AS ls FROM norm))))
WHERE cents IS NOT NULL OR date_iso IS NOT NULL OR phrase <> ''"""
ORACLE["page_extract"] = v.sql("SELECT * EXCLUDE (version) FROM facts JOIN newest USING (page_key, version)")

_FIELD = ("(SELECT page_key, 'lines.' || line_no || '.' || c AS path, val FROM (UNPIVOT (SELECT page_key,"
          " line_no, cents, date_iso, phrase, mode FROM facts JOIN ranked USING (page_key, version) WHERE rn = {0})"
          " ON cents, date_iso, phrase, mode INTO NAME c VALUE val))")
v.VIEWS["ranked"] = """SELECT page_key, version, row_number() OVER (PARTITION BY page_key
  ORDER BY fetched_epoch DESC, content_hash DESC) AS rn, count(*) OVER (PARTITION BY page_key) AS n FROM norm"""
ORACLE["page_field_delta"] = v.sql(f"""
SELECT page_key, path, a.val AS value_a, b.val AS value_b, CASE WHEN a.val IS NULL THEN 'added'
  WHEN b.val IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM {_FIELD.format(2)} a FULL JOIN {_FIELD.format(1)} b USING (page_key, path)
WHERE a.val IS DISTINCT FROM b.val AND page_key IN (SELECT page_key FROM ranked WHERE n > 1)""")

_PICK = " ".join(
    f"WHEN {_rx('url', p, 1)} <> ''{' AND pdf' if pdf else ''} THEN "
    f"{{'s': '{n}', 'i': {_rx('url', p, 1)}}}" for n, p, pdf in tx.PICKS)
ORACLE["page_schedule_ids"] = v.sql(f"""
SELECT page_key, f.i AS schedule_id, min(f.s) AS strategy, count(*) AS url_count FROM (
  SELECT page_key, CASE {_PICK} END AS f FROM (
    SELECT *, contains(lower(url), '.pdf') AS pdf FROM (
      SELECT DISTINCT page_key, unnest(list_concat(regexp_extract_all(html, {_lit(tx.URL_ATTRIBUTE)}, 1),
        regexp_extract_all(html, {_lit(tx.URL_IN_TEXT)}))) AS url FROM page_captures JOIN newest USING (page_key, version))
    WHERE NOT regexp_matches(url, '^(#|javascript:|mailto:|tel:)')))
WHERE f IS NOT NULL GROUP BY 1, 2""")

ORACLE["price_normalize"] = f"""
SELECT p_partkey, cell, CASE WHEN free THEN 0 WHEN ok AND dec <= 2 THEN
    (regexp_replace(cell, '[$, \\t]', '', 'g')::DECIMAL(18,2) * 100)::BIGINT END AS cents,
  CASE WHEN free THEN '' WHEN NOT ok THEN 'NOT_A_PRICE' WHEN dec > 2 THEN 'TOO_MANY_DECIMALS' ELSE ''
    END AS problem
FROM (SELECT *, lower(cell) = 'free' AS free, regexp_matches(cell, {_lit(tx.PRICE_CELL)}) AS ok,
    length(regexp_extract(cell, {_lit(tx.PRICE_CELL)}, 2)) AS dec
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Free'
      WHEN p_partkey % 11 = 0 THEN '$' || p || '-$9' WHEN p_partkey % 13 = 0 THEN p || '9'
      WHEN p_partkey % 5 = 0 THEN '$1,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0')
      ELSE '$ ' || p END AS cell
    FROM (SELECT p_partkey, p_retailprice::DECIMAL(12,2)::VARCHAR AS p FROM part)))"""

ORACLE["holiday_normalize"] = f"""
SELECT o_orderkey, printed, CASE o_orderkey % 6 WHEN 3 THEN try_cast('2026-' || strftime(d, '%m-%d')
    AS DATE) WHEN 5 THEN try_cast('2026-' || strftime(d, '%m-%d') AS DATE)
  WHEN 2 THEN try_cast('20' || strftime(d, '%y-%m-%d') AS DATE) ELSE d END AS day,
  {_service('words')} AS service, {_mode('words')} AS mode
FROM (SELECT o_orderkey, d, CASE o_orderkey % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d')
    WHEN 1 THEN strftime(d, '%Y%m%d')
    WHEN 2 THEN strftime(d, '%-m/%-d/%y') WHEN 3 THEN strftime(d, '%-m/%-d')
    WHEN 4 THEN strftime(d, '%A, %B %-d, %Y') ELSE strftime(d, '%b. %-d') END AS printed,
    o_orderpriority || CASE o_orderkey % 4 WHEN 0 THEN ' Sunday schedule' WHEN 1 THEN ' No Service'
      WHEN 2 THEN ' light rail weekend service' ELSE '' END AS words
  FROM (SELECT *, o_orderdate::DATE AS d FROM orders))"""

_PRICES = ORACLE["price_normalize"]
ORACLE["fare_rows"] = f"""
SELECT page_key, row_no, CASE WHEN reason IS NULL THEN slug || CASE WHEN turn > 1 THEN '-' || turn ELSE '' END END AS fare_id,
  mode, category, label, cents AS price_cents, '$' || (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS price,
  cell AS price_as_published, notes, reason
FROM (SELECT *, row_number() OVER (PARTITION BY page_key, CASE WHEN reason IS NULL THEN slug END ORDER BY row_no) AS turn
  FROM (SELECT *, trim(regexp_replace(lower(mode || ' ' || category || ' ' || label), '[^a-z0-9]+', '-', 'g'), '-') AS slug
    FROM (SELECT 'src' || (p_partkey % 20) AS page_key, p_partkey AS row_no,
        CASE p_partkey % 4 WHEN 0 THEN 'Bus' WHEN 1 THEN 'Rail' ELSE '' END AS mode, 'Size ' || p_size AS category,
        p_name AS label, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE cell END AS cell,
        CASE WHEN p_partkey % 17 <> 0 THEN cents END AS cents, CASE WHEN p_partkey % 9 = 0 THEN 'Valid today' ELSE '' END AS notes,
        CASE WHEN p_partkey % 17 = 0 THEN 'NO_PRICE' ELSE nullif(problem, '') END AS reason
      FROM ({_PRICES}) JOIN part USING (p_partkey))))"""

_DAYS = ORACLE["holiday_normalize"].replace("'2026-'", "'1995-'")
ORACLE["holiday_rows"] = f"""
SELECT page_key, row_no, name, date_as_published, date, strftime(date, '%A') AS weekday, s.m AS mode, s.p AS published,
  CASE WHEN s.p <> '' THEN {_service('s.p')} END AS service_type, modes_differ, reason
FROM (SELECT *, unnest(CASE WHEN reason IS NULL THEN list_filter([{{'m': 'bus', 'p': bus}}, {{'m': 'rail', 'p': rail}}],
      lambda x: x.p <> '') ELSE [NULL] END) AS s
  FROM (SELECT *, bus <> '' AND rail <> '' AND {_service('bus')} <> {_service('rail')} AS modes_differ,
      CASE WHEN date IS NULL THEN 'DATE_UNREADABLE' WHEN year(date) <> 1995 THEN 'OTHER_YEAR'
        WHEN bus = '' AND rail = '' THEN 'NO_SERVICE_NAMED' END AS reason
    FROM (SELECT 'src' || (o_orderkey % 15) AS page_key, o_orderkey AS row_no, 'H' || (o_orderkey % 50) AS name,
        printed AS date_as_published, day AS date,
        CASE o_orderkey % 4 WHEN 0 THEN 'Sunday schedule' WHEN 1 THEN 'No Service' WHEN 2 THEN '' ELSE 'Regular' END AS bus,
        CASE o_orderkey % 5 WHEN 0 THEN 'Weekend' WHEN 1 THEN '' WHEN 2 THEN 'Sunday' WHEN 3 THEN 'Snow' ELSE 'Holiday' END AS rail
      FROM ({_DAYS}))))"""

# ---------------------------------------------------------------------- quality --
_CHECK_SQL = {
    "stop_code_present": """SELECT feed_id, round(avg(CASE WHEN stop_code <> '' THEN 1.0 ELSE 0.0 END),
      4)::DOUBLE AS x, x::VARCHAR AS observed, x >= 0.99 AS ok FROM stops_a
      WHERE location_type IN ('', '0') GROUP BY 1""",
    "stop_code_unique": """SELECT feed_id, count(*) FILTER (n > 1) AS x, x::VARCHAR AS observed,
      x <= 0 AS ok FROM (SELECT feed_id, stop_code, count(*) AS n FROM stops_a WHERE stop_code <> ''
      GROUP BY ALL) GROUP BY 1""",
    "stop_code_format": """SELECT feed_id, round(avg(CASE WHEN regexp_matches(stop_code,
      '^[0-9]{4,5}$') THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS x, x::VARCHAR AS observed, x >= 0.99 AS ok
      FROM stops_a WHERE stop_code <> '' GROUP BY 1""",
    "feed_not_expiring": f"""SELECT feed_id, (max({v.ymd('end_date')}) - DATE '$TODAY')::INTEGER AS x,
      x::VARCHAR AS observed, x >= 7 AS ok FROM calendar_a GROUP BY 1""",
    "no_frequencies_file": "SELECT feed_id, 0 AS x, '0' AS observed, true AS ok FROM zones",
    "max_time_bounded": f"""SELECT feed_id, max({v.seconds('departure_time')}) AS x,
      {v.clock('max(' + v.seconds('departure_time') + ')')} AS observed, x < 100800 AND
      count(*) FILTER ({v.seconds('departure_time')} IS NULL) = 0 AS ok
      FROM stop_times_a WHERE departure_time <> '' GROUP BY 1""",
    "timezone_unchanged": """SELECT feed_id, agency_timezone AS observed,
      agency_timezone = CASE feed_id WHEN 'F2' THEN 'America/Phoenix' ELSE agency_timezone END AS ok
      FROM agency_a""",
    "no_fare_files": "SELECT feed_id, '' AS observed, true AS ok FROM zones",
    "stop_ids_stable": """SELECT b.feed_id, round(avg(CASE WHEN a.stop_code IS NULL THEN 0.0 ELSE 1.0
      END), 4)::DOUBLE AS x, x::VARCHAR AS observed, x >= 0.98 AS ok
      FROM (SELECT DISTINCT feed_id, stop_code FROM stops_b WHERE stop_code <> '') b LEFT JOIN
      (SELECT DISTINCT feed_id, stop_code FROM stops_a) a USING (feed_id, stop_code) GROUP BY 1""",
    "rail_route_ids_stable": """SELECT feed_id, '-' || count(*) FILTER (a.route_id IS NULL) || '/+' ||
      count(*) FILTER (b.route_id IS NULL) AS observed,
      count(*) FILTER (a.route_id IS NULL OR b.route_id IS NULL) = 0 AS ok
      FROM (SELECT * FROM routes_b WHERE trim(route_type) IN ('0','1','2')) b FULL JOIN
      (SELECT * FROM routes_a WHERE trim(route_type) IN ('0','1','2')) a USING (feed_id, route_id)
      GROUP BY 1""",
    "rt_fresh": """SELECT feed_id, max(age_at_fetch) AS x, x::VARCHAR AS observed,
      x <= 300 AND bool_and(available) AS ok FROM health WHERE entity_kind <> 'shapes' GROUP BY 1
      HAVING min(fetched_ago) <= 300""",
    "rt_join_rate": """SELECT feed_id, join_rate::VARCHAR AS observed, join_rate >= 0.95 AS ok
      FROM join_rate""",
    "rt_wire_shape": """SELECT feed_id, coalesce(max(presence_rate) FILTER (NOT modelled), 0.0) AS x,
      x::VARCHAR AS observed, x <= 0.05 AS ok FROM census GROUP BY 1""",
    "fares_unchanged": """SELECT feed_id, h1 AS observed, h1 = h2 AS ok FROM zones, two_captures
      WHERE page_key = '1'""",
    "holidays_unchanged": "SELECT feed_id, '' AS observed, NULL::BOOLEAN AS ok FROM zones",
    "terms_unchanged": """SELECT feed_id, h1 AS observed, false AS ok FROM zones, two_captures
      WHERE page_key = '4'""",
}


def _suite(today: str, optional: bool) -> str:
    parts = []
    for name, severity, category, expected in quality.ASSUMPTIONS:
        body = _CHECK_SQL[name].replace("$TODAY", today)
        if category != "static" and not optional:
            body = "SELECT feed_id, '' AS observed, NULL::BOOLEAN AS ok FROM zones"
        failed = "opportunity" if severity == "opportunity" else "fail"
        parts.append(f"""SELECT z.feed_id, '{name}' AS id, CASE WHEN ok IS NULL THEN 'skip' WHEN ok
  THEN 'pass' ELSE '{failed}' END AS status, CASE WHEN ok IS NOT NULL THEN observed END AS observed,
  '{expected}' AS expected, '{severity}' AS severity, '{category}' AS category,
  {quality.CATEGORY_RANK[category]} AS category_rank
FROM zones z LEFT JOIN (SELECT feed_id, observed, ok FROM ({body})) USING (feed_id)""")
    return " UNION ALL ".join(parts)


v.VIEWS["suite"] = _suite("2026-11-01", True)
ORACLE["assumptions"] = v.sql("SELECT * FROM suite")
ORACLE["assumptions_static_only"] = v.sql(_suite("2026-12-28", False))

ORACLE["feed_status"] = v.sql(f"""
SELECT feed_id, CASE max(rank) WHEN 2 THEN 'broken' WHEN 1 THEN 'attention' ELSE 'ok' END AS status,
  {', '.join(f"count(*) FILTER (area = '{a}' AND rank > 0) AS {a}_findings" for a in quality.AREAS)},
  'snapshots' AS not_checked
FROM (SELECT feed_id, 1 AS rank, 'feed' AS area FROM zones
  UNION ALL SELECT feed_id, CASE WHEN status = 'fail' THEN 2 ELSE 0 END, 'assertions' FROM suite
  UNION ALL SELECT feed_id, CASE WHEN NOT available OR stale THEN 1 ELSE 0 END, 'realtime' FROM health
    WHERE entity_kind <> 'shapes'
  UNION ALL SELECT 'F' || (page_key::INTEGER % 3), CASE WHEN status IN ('changed',
    'extraction_failed') THEN 1 ELSE 0 END, 'drift' FROM drift
  UNION ALL SELECT feed_id, 1, 'snapshots' FROM zones)
GROUP BY 1""")

# -------------------------------------------------------------------- artifacts --
v.VIEWS["snapshots"] = """
SELECT 'web-' || page_id || '-' || c || '-' || sha256(html) AS capture_ref, 'web' AS kind,
  'src' || (page_id % 20) AS source, CASE WHEN page_id % 40 = 7 THEN repeat('0', 64)
    ELSE sha256(html) END AS sha256, sha256(html) AS actual,
  octet_length(encode(html))::INTEGER AS bytes, 1790000000 + page_id * 60 + c * 30 AS fetched_epoch,
  CASE WHEN page_id % 25 = 0 AND c = 0 THEN 'pin-' || page_id END AS pin
FROM (SELECT *, unnest(CASE WHEN page_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS c FROM pages)"""

ORACLE["snapshot_manifest"] = """
SELECT 'web-src' || (page_id % 20) || '-' || strftime(to_timestamp(t) AT TIME ZONE 'UTC',
  '%Y%m%dT%H%M%SZ') || '-' || sha256(html) AS capture_ref, 'web' AS kind, 'src' || (page_id % 20) AS source,
  sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes, t AS fetched_epoch,
  CASE WHEN page_id % 25 = 0 THEN 'pin-' || page_id END AS pin
FROM (SELECT *, 1790000000 + page_id * 60 AS t FROM pages)"""
ORACLE["snapshot_latest"] = v.sql("""
SELECT kind, source, fetched_epoch, capture_ref, sha256, bytes FROM (SELECT *, row_number() OVER (
  PARTITION BY kind, source ORDER BY fetched_epoch DESC, capture_ref DESC) AS rn FROM snapshots)
WHERE rn = 1""")
ORACLE["snapshot_duplicates"] = v.sql("""
SELECT kind, source, sha256, count(*) AS copies, sum(bytes)::BIGINT AS bytes,
  arg_min(capture_ref, fetched_epoch) AS first_ref FROM snapshots GROUP BY 1, 2, 3
HAVING count(*) > 1""")
ORACLE["snapshot_retention"] = v.sql("""
SELECT capture_ref, source, bytes FROM (SELECT *, row_number() OVER (PARTITION BY kind, source
  ORDER BY fetched_epoch DESC, capture_ref) AS rn FROM snapshots) WHERE rn > 5 AND pin IS NULL""")
ORACLE["snapshot_integrity"] = v.sql(
    "SELECT capture_ref, sha256 = actual AS intact FROM snapshots")

v.VIEWS["stop_badges"] = """
SELECT feed_id, stop_id, array_to_string(list(badge ORDER BY CASE WHEN regexp_full_match(badge,
  '[0-9]+') THEN 0 ELSE 1 END, try_cast(badge AS BIGINT), badge), '|') AS routes
FROM (SELECT DISTINCT feed_id, stop_id, CASE WHEN route_short_name <> '' THEN route_short_name
    ELSE route_id END AS badge
  FROM stop_times_a JOIN trips_a USING (feed_id, trip_id) JOIN routes_a USING (feed_id, route_id))
GROUP BY 1, 2"""
v.VIEWS["code_index"] = """
SELECT s.feed_id, s.stop_code AS code, s.stop_id, s.stop_name, s.parent_station, s.location_type,
  n - 1 AS shadowed, coalesce(b.routes, '') AS routes
FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, stop_code ORDER BY stop_id) AS rn,
  count(*) OVER (PARTITION BY feed_id, stop_code) AS n FROM stops_a WHERE stop_code <> '') s
LEFT JOIN stop_badges b ON b.feed_id = s.feed_id AND b.stop_id = s.stop_id WHERE rn = 1"""
ORACLE["stops_index"] = v.sql("SELECT * FROM code_index")
ORACLE["stops_index_report"] = v.sql("""
SELECT feed_id, sum(n)::BIGINT AS stops, count(*) FILTER (stop_code <> '') AS codes,
  count(*) FILTER (stop_code <> '' AND n > 1) AS shared_codes,
  coalesce(sum(n) FILTER (stop_code = ''), 0)::BIGINT AS without_code
FROM (SELECT feed_id, stop_code, count(*) AS n FROM stops_a GROUP BY 1, 2) GROUP BY 1""")

_PLAN = " ".join(
    f"WHEN table_name = '{t}' THEN column_name IN ({', '.join(repr(c) for c in p['balanced'])})"
    for t, p in artifacts.COLUMN_PLAN.items())
ORACLE["compact_decisions"] = v.sql(f"""
SELECT feed_id, table_name, column_name, reason = '' AS kept, reason,
  CASE WHEN reason <> '' THEN text_bytes + rows ELSE 0 END AS bytes_saved
FROM (SELECT *, CASE WHEN non_empty = 0 THEN 'empty_on_every_row' WHEN NOT (CASE {_PLAN} ELSE true END)
  THEN 'not_in_strategy' ELSE '' END AS reason FROM profile)""")

_KEPT = """
kept_services AS (SELECT DISTINCT feed_id, service_id FROM services
  WHERE service_date BETWEEN DATE '2026-01-01' AND DATE '2026-01-30'),
k_trips AS (SELECT t.* FROM trips_a t SEMI JOIN kept_services USING (feed_id, service_id)),
k_stop_times AS (SELECT s.* FROM stop_times_a s SEMI JOIN k_trips USING (feed_id, trip_id)),
k_stops AS (SELECT s.* FROM stops_a s WHERE (feed_id, stop_id) IN (
    SELECT feed_id, stop_id FROM k_stop_times) OR (feed_id, stop_id) IN (
    SELECT feed_id, parent_station FROM stops_a SEMI JOIN k_stop_times USING (feed_id, stop_id))),
k_calendar AS (SELECT c.* FROM calendar_a c SEMI JOIN kept_services USING (feed_id, service_id)),
k_calendar_dates AS (SELECT c.* FROM calendar_dates_a c SEMI JOIN kept_services
  USING (feed_id, service_id)),
k_agency AS (SELECT * FROM agency_a), k_routes AS (SELECT * FROM routes_a),
k_feed_info AS (SELECT * FROM feed_info_a)"""


def _kept(select) -> str:
    body = " UNION ALL ".join(select(t) for t in _T["a"])
    head = v.sql(_KEPT + body)
    ctes, _, _ = head.rpartition(_KEPT)
    return ctes.rstrip() + "," + _KEPT + "\n" + body


ORACLE["compact_prune"] = _kept(
    lambda t: f"SELECT feed_id, '{t}' AS table_name, count(*) AS rows FROM k_{t} GROUP BY 1")


def _sink_columns(t: str) -> list[str]:
    plan = artifacts.COLUMN_PLAN.get(t, {}).get("balanced")
    return _COLS[t] if plan is None else [c for c in plan if c in _COLS[t]]


def _sized(t: str, columns: list[str], prefix: str) -> str:
    size = " + ".join(f"length({c})" for c in columns)
    return (f"SELECT feed_id, '{t}' AS table_name, count(*) AS rows, sum({size})::BIGINT AS characters "
            f"FROM {prefix} GROUP BY 1")


ORACLE["compact_sink"] = _kept(lambda t: f"""
SELECT *, (SELECT string_agg(DISTINCT column_name, ',' ORDER BY column_name) FROM profile
  WHERE table_name = '{t}' AND non_empty > 0 AND column_name IN ({', '.join(map(repr, _sink_columns(t)))})) AS columns
FROM ({_sized(t, _sink_columns(t), f"k_{t}")})""")
ORACLE["gtfs_scan"] = v.sql(" UNION ALL ".join(
    f"SELECT *, '{','.join(sorted(_COLS[t]))}' AS columns FROM ({_sized(t, _COLS[t], f'{t}_a')})" for t in _T["a"]))


def _json(fields: list[tuple[str, str, bool]]) -> str:
    """JSON text with sorted keys; the flag marks text fields."""
    parts = [f"'\"{k}\":' || " + (f"to_json({x})::VARCHAR" if text else f"{x}::VARCHAR")
             for k, x, text in sorted(fields)]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_INDEX_JSON = _json([(c, c, c != "shadowed") for c in
                     ("feed_id", "code", "stop_id", "stop_name", "parent_station", "location_type",
                      "shadowed", "routes")] + [("snapshot_id", "'A'", True)])
v.VIEWS["index_json"] = f"SELECT feed_id, code, {_INDEX_JSON} AS json FROM code_index"
ORACLE["json_artifact_sink"] = v.sql(
    "SELECT feed_id, code, json, sha256(json) AS sha256 FROM index_json")
_ROUTE_JSON = _json([(c, c, True) for c in ("feed_id", "snapshot_id", *_COLS["routes"])])
ORACLE["artifact_manifest"] = v.sql(f"""
SELECT 'stops_index' AS name, count(*) AS rows, sum(octet_length(encode(json)) + 1)::BIGINT AS bytes,
  true AS hashed FROM index_json
UNION ALL SELECT 'routes', count(*), sum(octet_length(encode({_ROUTE_JSON})) + 1)::BIGINT, true
FROM routes_a""")

_GF = artifacts.GOLDEN_FIELDS
v.VIEWS["g_fresh"] = f"""
SELECT query_id AS case_id, rank AS position, route_short_name, headsign,
  {v.local_iso('departure_epoch', 'zone')} AS departure_local, gtfs_time, service_date::VARCHAR
  AS service_date, trip_id, direction_id, after_midnight::VARCHAR AS after_midnight,
  substr(trip_id, 2)::BIGINT AS t FROM departures"""
v.VIEWS["g_pairs"] = """
SELECT case_id, position, t % 41 <> 0 AS golden, CASE WHEN t % 41 = 0 THEN 'x' ELSE concat_ws(', ',
  CASE WHEN t % 86 = 0 AND direction_id <> '9' THEN 'direction_id' END,
  CASE WHEN t % 43 = 0 AND headsign <> 'Depot' THEN 'headsign' END) END AS diff FROM g_fresh"""
v.VIEWS["g_errors"] = """
SELECT q.query_id AS case_id, 'StopNotFound' AS actual_error, CASE WHEN q.query_id LIKE '%/3' THEN NULL
  WHEN q.query_id LIKE '%/2' THEN 'FeedExpired' ELSE 'StopNotFound' END AS expected_error
FROM board_queries q WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.feed_id = q.feed_id
  AND r.needle = q.needle)"""
ORACLE["golden_regression"] = v.sql("""
SELECT case_id, reason IS NULL AS matches, expected_count, actual_count, expected_error, actual_error,
  reason
FROM (SELECT q.query_id AS case_id, coalesce(p.g, 0) AS expected_count, coalesce(p.f, 0)
    AS actual_count, e.expected_error, e.actual_error,
    CASE WHEN e.expected_error IS DISTINCT FROM e.actual_error THEN CASE
        WHEN e.expected_error IS NULL THEN 'expected departures but got ' || e.actual_error
        ELSE 'error type changed' END
      WHEN p.g <> p.f THEN 'count changed: ' || p.g || ' -> ' || p.f
      WHEN first IS NOT NULL THEN 'departure ' || (first.position - 1) || ' differs on: '
        || first.diff END AS reason
  FROM board_queries q
  LEFT JOIN (SELECT case_id, count(*) FILTER (golden) AS g, count(*) AS f,
      min({'position': position, 'diff': diff}) FILTER (diff <> '') AS first
    FROM g_pairs GROUP BY 1) p ON p.case_id = q.query_id
  LEFT JOIN g_errors e ON e.case_id = q.query_id)""")

ORACLE["feed_sql"] = v.sql("""
SELECT feed_id, service_id, route_id, count(*) AS calls, count(DISTINCT stop_id) AS stops
FROM stop_times_a JOIN trips_a USING (feed_id, trip_id) GROUP BY ALL""")
ORACLE["paginate"] = v.sql("""
SELECT feed_id, row, stop_id, stop_name, total, total > 150 AS has_more,
  CASE WHEN total > 150 THEN 150 END AS next_offset
FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY stop_name, stop_id)::INTEGER AS row,
  count(*) OVER (PARTITION BY feed_id) AS total FROM stops_a) WHERE row BETWEEN 101 AND 150""")

ORACLE["departures_lookup"] = ORACLE["departures"]

ORACLE["stop_search_words"] = v.sql("""
SELECT feed_id, term, count(*) AS stops, min(stop_id) AS first_stop FROM stops_a JOIN (
    SELECT list_last(string_split(p_name, ' ')) AS term FROM part UNION SELECT lower(n_name) FROM nation)
  ON contains(lower(stop_name), lower(term)) GROUP BY 1, 2""")

ORACLE["feed_publish"] = v.sql("""
SELECT feed_id, 'A' AS snapshot_id, 'routes' AS table_name, count(*) AS rows FROM routes_a GROUP BY 1
UNION ALL SELECT feed_id, 'B', 'routes', count(*) FROM routes_b GROUP BY 1
UNION ALL SELECT feed_id, 'A', 'stops', count(*) FROM stops_a GROUP BY 1
UNION ALL SELECT feed_id, 'B', 'stops', count(*) FROM stops_b GROUP BY 1
UNION ALL SELECT feed_id, 'A', 'trips', count(*) FROM trips_a WHERE feed_id = 'F1' OR direction_id = '0' GROUP BY 1
UNION ALL SELECT feed_id, 'B', 'trips', count(*) FROM trips_b GROUP BY 1""")

ORACLE["id_life_spans"] = """
WITH h AS (SELECT 'F' || f AS feed_id, n, 'S' || k AS stop_id, CASE WHEN k % 97 = 0 THEN '' ELSE
      (10000 + CASE WHEN k % 7 = 1 AND n > 4 AND k > 1 THEN k - 1 ELSE k END)::VARCHAR END AS stop_code
    FROM (SELECT p_partkey AS k, unnest(range(1, 7)) AS n FROM part), (SELECT unnest([0, 1, 2]) AS f)
    WHERE NOT ((k % 7 = 0 AND n > 4) OR (k % 11 = 0 AND n IN (2, 3)) OR (k % 13 = 0 AND n = 5) OR (k % 17 = 0 AND n < 3))),
  c AS (SELECT feed_id, n, 'id' AS kind, stop_id AS value, stop_code AS other FROM h
    UNION ALL SELECT feed_id, n, 'code', stop_code, stop_id FROM h WHERE stop_code <> ''),
  s AS (SELECT *, n - lag(n) OVER (PARTITION BY feed_id, kind, value ORDER BY n) - 1 AS gap
    FROM (SELECT DISTINCT feed_id, n, kind, value FROM c)),
  o AS (SELECT feed_id, kind, value, count(DISTINCT other) AS holders FROM c GROUP BY 1, 2, 3)
SELECT feed_id, kind, value, 'W' || min(n) AS first_snapshot, 'W' || max(n) AS last_snapshot, count(*) AS seen,
  count(*) FILTER (gap > 0) + 1 AS spells, coalesce(max(gap), 0)::INTEGER AS longest_gap, max(n) = 6 AS alive,
  any_value(holders) AS holders
FROM s JOIN o USING (feed_id, kind, value) GROUP BY 1, 2, 3"""

# ---------------------------------------------------------- landing and streams --
ORACLE["stream_freshness"] = v.sql("""
SELECT w AS window_start, feed_id, entity_kind, count(*) AS captures,
  max(fetched_epoch - header_ts) AS worst_age,
  round(avg(CASE WHEN fetched_epoch - header_ts > 300 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS stale_share,
  max(bytes) AS max_bytes,
  round((max(fetched_epoch) - min(fetched_epoch)) / nullif(count(*) - 1, 0), 4) AS mean_gap
FROM (SELECT *, fetched_epoch // 3600 * 3600 AS w, (SELECT max(fetched_epoch) FROM headers) AS latest
  FROM headers) WHERE w + 3600 <= latest - 600 GROUP BY 1, 2, 3""")

# Spells: a fetch more than five minutes after the last opens one. Those the watermark, six
# hours behind the newest fetch, has not closed are still open.
ORACLE["stream_outages"] = v.sql("""
SELECT *, row_number() OVER (PARTITION BY feed_id, entity_kind ORDER BY seconds DESC, silent_from)::INTEGER AS longest
FROM (SELECT feed_id, entity_kind, lag(last_fetch) OVER p AS silent_from, spell_start AS silent_until,
    spell_start - lag(last_fetch) OVER p AS seconds
  FROM (SELECT feed_id, entity_kind, min(fetched_epoch) AS spell_start, max(fetched_epoch) AS last_fetch, max(ts) AS last_ts,
      any_value(newest) AS newest
    FROM (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY feed_id, entity_kind ORDER BY ts) AS spell
      FROM (SELECT *, ts >= lag(ts) OVER (PARTITION BY feed_id, entity_kind ORDER BY ts) + INTERVAL 5 MINUTE AS apart,
          max(ts) OVER () AS newest FROM headers))
    GROUP BY feed_id, entity_kind, spell)
  WHERE last_ts + INTERVAL 5 MINUTE <= newest - INTERVAL 6 HOUR
  WINDOW p AS (PARTITION BY feed_id, entity_kind ORDER BY spell_start))
WHERE silent_from IS NOT NULL""")

# The newest header since the trip's last silence of more than two hours.
ORACLE["stream_latest_trip_state"] = """
WITH u AS (SELECT 'F' || (user_id % 3) AS feed_id, 'T' || user_id AS trip_id, t, {'h': t - k * 60,
      'e': event_id, 'd': trunc(value * 10)::INTEGER - 240, 't': t} AS r
    FROM (SELECT *, floor(epoch(ts))::BIGINT AS t, json_extract_string(props, '$.k')::BIGINT AS k FROM events)),
  s AS (SELECT *, max(t) OVER () AS all_seen, max(t) OVER (PARTITION BY feed_id) AS feed_seen,
      count(*) FILTER (again) OVER (PARTITION BY feed_id, trip_id ORDER BY t) AS spell
    FROM (SELECT *, t - lag(t) OVER (PARTITION BY feed_id, trip_id ORDER BY t) > 7200 AS again FROM u)),
  n AS (SELECT feed_id, trip_id, spell, max(r) AS s, max(t) AS last_seen, any_value(all_seen) AS all_seen,
      any_value(feed_seen) AS feed_seen FROM s GROUP BY feed_id, trip_id, spell
    QUALIFY spell = max(spell) OVER (PARTITION BY feed_id, trip_id))
SELECT feed_id, trip_id, s.h AS header_ts, s.e AS entity_pos, s.d AS delay, s.t AS seen_epoch, last_seen
FROM n WHERE last_seen >= feed_seen - 7200 AND last_seen + 7200 > all_seen - 21600"""

ORACLE["stream_live_board"] = v.sql("""
SELECT feed_id, service_date, trip_id, stop_id, stop_sequence, departure_epoch, capture_id, entity,
  stu_pos, realtime, CASE WHEN NOT realtime THEN 'SCHEDULED_ONLY'
    WHEN trip_relationship = 'CANCELED' THEN 'CANCELED' WHEN relationship = 'SKIPPED' THEN 'SKIPPED'
    WHEN e IS NULL AND dl IS NULL THEN 'NO_PREDICTION'
    WHEN NOT coalesce(abs(dv) <= 43200, false) THEN 'IMPLAUSIBLE_DELAY' ELSE relationship END AS status,
  CASE WHEN live THEN coalesce(dv, e) END AS delay_seconds,
  CASE WHEN live AND abs(dv) <= 43200 THEN departure_epoch + dv END AS predicted_epoch
FROM (SELECT *, realtime AND trip_relationship <> 'CANCELED' AND relationship <> 'SKIPPED'
    AND (e IS NOT NULL OR dl IS NOT NULL) AS live,
    CASE WHEN e IS NULL THEN dl WHEN e BETWEEN -3000000000 AND 6000000000
      THEN e - departure_epoch END AS dv
  FROM (WITH n AS MATERIALIZED (SELECT e.feed_id, e.service_date, e.trip_id, e.stop_id, e.stop_sequence, e.departure_epoch
        FROM events_on_days e JOIN (SELECT DISTINCT feed_id, DATE '1970-01-01' + unnest(range(d - back, d + 3))::INTEGER AS service_date
          FROM (SELECT DISTINCT feed_id, seen_epoch // 86400 AS d FROM updates)
          JOIN (SELECT feed_id, max(seconds) // 86400 + 1 AS back FROM calls GROUP BY 1) USING (feed_id))
        USING (feed_id, service_date)),
      u AS MATERIALIZED (SELECT u.feed_id, u.trip_id, u.capture_id, u.entity_pos, u.stu_pos, u.stop_id AS at, u.stop_sequence AS nth,
          u.relationship, u.event_time, u.event_delay, u.seen_epoch, t.start_date, t.trip_relationship
        FROM stop_updates u JOIN trip_updates t ON t.feed_id = u.feed_id AND t.capture_id = u.capture_id
          AND t.entity_pos = u.entity_pos),
      m AS (SELECT * FROM n JOIN u ON u.feed_id = n.feed_id AND u.trip_id = n.trip_id AND u.at = n.stop_id
        UNION ALL SELECT * FROM n JOIN u ON u.feed_id = n.feed_id AND u.trip_id = n.trip_id AND u.nth = n.stop_sequence)
    SELECT feed_id, service_date, trip_id, stop_id, stop_sequence, departure_epoch, capture_id, entity_pos AS entity, stu_pos,
      true AS realtime, trip_relationship, relationship, event_time AS e, event_delay::BIGINT AS dl
    FROM m WHERE departure_epoch - seen_epoch BETWEEN -21600 AND 64799
      AND (start_date = '' OR start_date = strftime(service_date, '%Y%m%d'))
    QUALIFY row_number() OVER (PARTITION BY feed_id, service_date, trip_id, stop_id, stop_sequence
      ORDER BY seen_epoch DESC, entity_pos DESC, stu_pos) = 1))""")
