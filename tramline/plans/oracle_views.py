"""DuckDB twins of the demo views, as named common table expressions."""

from __future__ import annotations

import re

from tramline.sources import demo


def _values(rows, columns):
    body = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"


FEEDS = "(SELECT unnest(['F0','F1','F2']) AS feed_id)"


def _stops(b: bool) -> str:
    lat = "385000 + p_partkey" + (" + CASE WHEN p_partkey % 29 = 0 THEN 3 ELSE 0 END" if b else "")
    lat_text = f"(({lat}) // 10000)::VARCHAR || '.' || lpad((({lat}) % 10000)::VARCHAR, 4, '0')"
    lon = "(90400 - p_size::BIGINT * 2)"
    name = "p_name"
    if b:
        name = "CASE WHEN p_partkey % 41 = 0 THEN p_name || ' Plaza' ELSE p_name END"
        lat_text = f"CASE WHEN p_partkey % 89 = 0 THEN '' ELSE {lat_text} END"
    return f"""
SELECT feed_id, '{'B' if b else 'A'}' AS snapshot_id, 'S' || p_partkey AS stop_id,
  CASE WHEN p_partkey % 97 = 0 THEN '' ELSE (p_partkey + 10000
    - CASE WHEN p_partkey % 211 = 1 THEN 1 ELSE 0 END)::VARCHAR END AS stop_code,
  {name} AS stop_name, {lat_text} AS stop_lat,
  '-' || ({lon} // 1000)::VARCHAR || '.' || lpad(({lon} % 1000)::VARCHAR, 3, '0') AS stop_lon,
  CASE WHEN p_partkey % 50 = 0 THEN '1' ELSE '0' END AS location_type,
  CASE WHEN p_partkey % 50 IN (1, 2) THEN 'S' || (p_partkey - p_partkey % 50) ELSE '' END
    AS parent_station, '' AS wheelchair_boarding
FROM part, {FEEDS} {'WHERE p_partkey % 53 <> 0' if b else ''}"""


def _routes(b: bool) -> str:
    src = "nation"
    name, kind = "n_name", "CASE WHEN n_regionkey = 0 THEN '0' WHEN n_regionkey = 4 THEN '3 ' ELSE '3' END"
    if b:
        src = """(SELECT n_name, n_regionkey, unnest(CASE WHEN n_nationkey % 20 = 1
          THEN [n_nationkey, n_nationkey + 100] ELSE [n_nationkey] END) AS n_nationkey
          FROM nation WHERE n_nationkey % 53 <> 0)"""
        name = "CASE WHEN n_nationkey % 7 = 3 THEN n_name || ' Line' ELSE n_name END"
        kind = f"CASE WHEN n_nationkey % 12 = 5 THEN '11' ELSE {kind} END"
    return f"""
SELECT feed_id, '{'B' if b else 'A'}' AS snapshot_id, 'R' || n_nationkey AS route_id,
  CASE WHEN n_nationkey % 10 = 9 THEN '' WHEN n_regionkey = 0 THEN 'L' || n_nationkey
    ELSE n_nationkey::VARCHAR END AS route_short_name,
  {name} AS route_long_name, {kind} AS route_type, '000000' AS route_color
FROM {src}, {FEEDS}"""


def _trips(b: bool) -> str:
    head = "'Dest ' || (o_custkey % 7)"
    if b:
        head = f"CASE WHEN o_orderkey % 61 = 0 THEN {head} || ' Express' ELSE {head} END"
    return f"""
SELECT 'F' || (o_orderkey % 3) AS feed_id, '{'B' if b else 'A'}' AS snapshot_id,
  '{'U' if b else 'T'}' || o_orderkey AS trip_id, 'R' || (o_custkey % 25) AS route_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'WK' WHEN '2' THEN 'SA' WHEN '3' THEN 'SU'
    WHEN '4' THEN 'WK2' ELSE 'XH' END AS service_id,
  {head} AS trip_headsign, (o_orderkey % 2)::VARCHAR AS direction_id, '' AS shape_id
FROM orders {'WHERE o_orderkey % 53 <> 0' if b else ''}"""


def clock(secs: str) -> str:
    return (f"(lpad((({secs}) // 3600)::VARCHAR, 2, '0') || ':' || "
            f"lpad((({secs}) % 3600 // 60)::VARCHAR, 2, '0') || ':' || "
            f"lpad((({secs}) % 60)::VARCHAR, 2, '0'))")


def _stop_times(b: bool) -> str:
    secs = "14400 + (l_orderkey * 613 + l_linenumber * 300) % 79200"
    if b:
        secs += " + CASE WHEN l_orderkey % 37 = 0 THEN 300 ELSE 0 END"
    return f"""
SELECT 'F' || (l_orderkey % 3) AS feed_id, '{'B' if b else 'A'}' AS snapshot_id,
  '{'U' if b else 'T'}' || l_orderkey AS trip_id, clk AS arrival_time, clk AS departure_time,
  'S' || l_partkey AS stop_id, l_linenumber::VARCHAR AS stop_sequence,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN '1' WHEN l_linenumber % 2 = 0 THEN ''
    ELSE '0' END AS pickup_type, '0' AS drop_off_type,
  CASE WHEN l_partkey % 31 = 0 THEN 'Via ' || (l_suppkey % 5) ELSE '' END AS stop_headsign
FROM (SELECT *, CASE WHEN l_partkey % 83 = 0 AND l_linenumber = 4 THEN ''
    WHEN l_linenumber = 7 AND secs < 36000 THEN substr({clock('secs')}, 2, 7)
    ELSE {clock('secs')} END AS clk
  FROM (SELECT *, {secs} AS secs FROM lineitem
        {'WHERE l_orderkey % 53 <> 0 AND l_partkey % 53 <> 0' if b else ''}))"""


def _per_feed(rows, columns, snapshot):
    return (f"SELECT feed_id, '{snapshot}' AS snapshot_id, {', '.join(columns)} "
            f"FROM {_values(rows, columns)}, {FEEDS}")


def seconds(text: str) -> str:
    """GTFS time to INTEGER seconds, NULL when malformed."""
    part = [f"trim(split_part(trim({text}), ':', {i}))" for i in (1, 2, 3)]
    return (f"(CASE WHEN regexp_full_match({text}, '\\s*[0-9]+\\s*:\\s*[0-9]+\\s*:\\s*[0-9]+\\s*') "
            f"THEN ({part[0]}::BIGINT * 3600 + {part[1]}::BIGINT * 60 + {part[2]}::BIGINT)::INTEGER END)")


def ymd(text: str) -> str:
    return f"try_strptime(trim({text}), '%Y%m%d')::DATE"


def noon_start(day: str, zone: str) -> str:
    return f"(epoch(timezone({zone}, ({day})::TIMESTAMP + INTERVAL 12 HOUR))::BIGINT - 43200)"


def midnight(day: str, zone: str) -> str:
    return f"epoch(timezone({zone}, ({day})::TIMESTAMP))::BIGINT"


def wall(epoch: str, zone: str) -> str:
    return f"timezone({zone}, to_timestamp({epoch}))"


def local_iso(e: str, zone: str) -> str:
    w = wall(e, zone)
    off = f"(epoch({w})::BIGINT - ({e}))"
    return (f"(strftime({w}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {off} < 0 THEN '-' ELSE '+' END || "
            f"lpad((abs({off}) // 3600)::VARCHAR, 2, '0') || ':' || "
            f"lpad((abs({off}) % 3600 // 60)::VARCHAR, 2, '0'))")


def _charters(b: bool) -> str:
    start = "(DATE '2026-01-01' + (c_custkey * 7 % 340)::INTEGER)"
    length = "CASE WHEN c_custkey % 11 = 0 THEN 20 ELSE 13 END" if b else "13"
    days = ", ".join(f"(c_custkey // {2 ** i} % 2)::VARCHAR AS {c}"
                     for i, c in enumerate(demo.CALENDAR_COLUMNS[1:8]))
    return f"""
UNION ALL BY NAME SELECT 'F' || (c_custkey % 3) AS feed_id, '{'B' if b else 'A'}' AS snapshot_id,
  'H' || c_custkey AS service_id, {days}, strftime({start}, '%Y%m%d') AS start_date,
  strftime({start} + {length}, '%Y%m%d') AS end_date
FROM customer {'WHERE c_custkey % 53 <> 0' if b else ''}"""


def _charter_days(b: bool) -> str:
    return f"""
UNION ALL BY NAME SELECT 'F' || (user_id % 3) AS feed_id, '{'B' if b else 'A'}' AS snapshot_id,
  'H' || user_id AS service_id, strftime(ts::DATE + 1009, '%Y%m%d') AS date,
  max(CASE WHEN event_type = 'error' THEN '2' ELSE '1' END) AS exception_type
FROM events {'WHERE user_id % 7 <> 0' if b else ''} GROUP BY ALL"""


VIEWS: dict[str, str] = {}
for _b, _s in ((False, "a"), (True, "b")):
    _S = _s.upper()
    VIEWS[f"stops_{_s}"] = _stops(_b)
    VIEWS[f"routes_{_s}"] = _routes(_b)
    VIEWS[f"trips_{_s}"] = _trips(_b)
    VIEWS[f"stop_times_{_s}"] = _stop_times(_b)
    VIEWS[f"calendar_{_s}"] = _per_feed(demo.CALENDAR[_S], demo.CALENDAR_COLUMNS, _S) + _charters(_b)
    VIEWS[f"calendar_dates_{_s}"] = _per_feed(
        demo.CALENDAR_DATES[_S], ["service_id", "date", "exception_type"], _S) + _charter_days(_b)
    VIEWS[f"agency_{_s}"] = ("SELECT * FROM " + _values(
        [(f, _S, "A1", f"Agency {f}", z) for f, z in demo.ZONES.items()],
        ["feed_id", "snapshot_id", "agency_id", "agency_name", "agency_timezone"]))
    VIEWS[f"feed_info_{_s}"] = _per_feed(
        [("Demo", "20260101", "20261231" if _s == "a" else "20270228", f"demo-{_S}")],
        ["feed_publisher_name", "feed_start_date", "feed_end_date", "feed_version"], _S)

VIEWS["zones"] = "SELECT feed_id, snapshot_id, agency_timezone AS zone FROM agency_a"

VIEWS["board_queries"] = f"""
SELECT feed_id, 'A' AS snapshot_id, feed_id || '/' || tag || '/' || n AS query_id, needle,
  epoch(moment)::BIGINT AS at_epoch, 90 AS window_minutes,
  CASE WHEN n = 4 THEN route_7 END AS route_filter
FROM (
  SELECT feed_id, 'q-' || stop_id AS tag, CASE WHEN stop_code <> '' THEN stop_code ELSE stop_id END
      AS needle,
    CASE WHEN suffix(stop_id, '7') THEN 'R' || substr(stop_id, -2, 1) END AS route_7 FROM stops_a
  UNION ALL
  SELECT feed_id, 'q-X' || s_suppkey, 'X' || s_suppkey, NULL FROM supplier, {FEEDS}
), (VALUES {', '.join(f"({n}, TIMESTAMP '{t}')" for n, t in demo.INSTANTS.items())}) AS i(n, moment)"""

VIEWS["services"] = f"""
SELECT feed_id, snapshot_id, service_id, service_date,
  CASE WHEN max(w) = 1 THEN 'weekly' ELSE 'exception' END AS origin
FROM (
  SELECT feed_id, snapshot_id, service_id, d AS service_date, 1 AS w FROM (
    SELECT *, unnest(generate_series({ymd('start_date')}, {ymd('end_date')}, INTERVAL 1 DAY))::DATE AS d
    FROM calendar_a)
  WHERE (CASE isodow(d) WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday
    WHEN 4 THEN thursday WHEN 5 THEN friday WHEN 6 THEN saturday ELSE sunday END) = '1'
  UNION ALL
  SELECT feed_id, snapshot_id, service_id, {ymd('date')}, 0 FROM calendar_dates_a
  WHERE exception_type = '1') x
WHERE NOT EXISTS (SELECT 1 FROM calendar_dates_a r WHERE r.feed_id = x.feed_id
  AND r.service_id = x.service_id AND {ymd('r.date')} = x.service_date AND r.exception_type <> '1')
GROUP BY ALL"""

VIEWS["services_b"] = re.sub(r"\b(calendar|calendar_dates)_a\b", r"\1_b", VIEWS["services"])

VIEWS["resolved"] = """
SELECT DISTINCT feed_id, needle, stop_id, matched_by, ambiguous FROM (
  SELECT m.feed_id, m.needle, s.stop_id, m.matched_by, m.ambiguous FROM matches m
    JOIN stops_a s ON s.feed_id = m.feed_id AND s.stop_id = m.stop_id
  UNION ALL
  SELECT m.feed_id, m.needle, c.stop_id, m.matched_by, m.ambiguous FROM matches m
    JOIN stops_a c ON c.feed_id = m.feed_id AND c.parent_station = m.stop_id
    WHERE m.location_type = '1')"""

VIEWS["matches"] = """
SELECT n.feed_id, n.needle, s.stop_id, s.location_type, 'stop_code' AS matched_by,
    count(*) OVER (PARTITION BY n.feed_id, n.needle) > 1 AS ambiguous
  FROM needles n JOIN stops_a s ON s.feed_id = n.feed_id AND s.stop_code = n.needle
UNION ALL
SELECT n.feed_id, n.needle, s.stop_id, s.location_type, 'stop_id',
    count(*) OVER (PARTITION BY n.feed_id, n.needle) > 1
  FROM needles n JOIN stops_a s ON s.feed_id = n.feed_id AND s.stop_id = n.needle
  WHERE NOT EXISTS (SELECT 1 FROM stops_a z WHERE z.feed_id = n.feed_id AND z.stop_code = n.needle)"""

VIEWS["needles"] = "SELECT DISTINCT feed_id, trim(needle) AS needle FROM board_queries"

VIEWS["calls"] = f"""
SELECT st.feed_id, st.trip_id, st.stop_id, st.stop_sequence, st.departure_time, st.pickup_type,
  st.stop_headsign, {seconds('st.departure_time')} AS seconds, t.route_id, t.service_id,
  t.trip_headsign, t.direction_id, r.route_short_name, r.route_long_name, r.route_type
FROM stop_times_a st JOIN trips_a t ON t.feed_id = st.feed_id AND t.trip_id = st.trip_id
JOIN routes_a r ON r.feed_id = t.feed_id AND r.route_id = t.route_id
WHERE st.departure_time <> ''"""

# Every departure of the network on the dates the board queries can touch.
VIEWS["board_dates"] = f"""
SELECT DISTINCT q.feed_id, d::DATE AS service_date FROM (
  SELECT q.feed_id, unnest(generate_series({wall('q.at_epoch', 'z.zone')}::DATE - 2,
    {wall('q.at_epoch + q.window_minutes * 60', 'z.zone')}::DATE, INTERVAL 1 DAY)) AS d
  FROM (SELECT DISTINCT feed_id, at_epoch, window_minutes FROM board_queries) q
  JOIN zones z ON z.feed_id = q.feed_id) q"""

VIEWS["events_on_days"] = f"""
SELECT c.*, s.service_date, z.zone, {noon_start('s.service_date', 'z.zone')} + c.seconds
  AS departure_epoch
FROM calls c JOIN services s ON s.feed_id = c.feed_id AND s.service_id = c.service_id
JOIN zones z ON z.feed_id = c.feed_id
WHERE c.pickup_type <> '1' AND c.seconds IS NOT NULL"""

VIEWS["board_hits"] = f"""
SELECT q.query_id, e.feed_id, e.stop_id, e.route_id, e.route_short_name, e.route_long_name,
  e.route_type, CASE WHEN e.stop_headsign <> '' THEN e.stop_headsign ELSE e.trip_headsign END
    AS headsign, e.direction_id, e.trip_id, e.stop_sequence, e.service_id, e.service_date,
  {clock('e.seconds')} AS gtfs_time, e.departure_epoch, e.zone, q.at_epoch,
  ((e.departure_epoch - q.at_epoch) // 60)::INTEGER AS minutes_away, e.seconds >= 86400 AS after_midnight
FROM board_queries q JOIN resolved r ON r.feed_id = q.feed_id AND r.needle = trim(q.needle)
JOIN (SELECT e.* FROM events_on_days e JOIN board_dates d
      ON d.feed_id = e.feed_id AND d.service_date = e.service_date) e
  ON e.feed_id = q.feed_id AND e.stop_id = r.stop_id
WHERE e.departure_epoch BETWEEN q.at_epoch AND q.at_epoch + q.window_minutes * 60
  AND (q.route_filter IS NULL OR q.route_filter = e.route_id OR q.route_filter = e.route_short_name)"""

VIEWS["departures"] = """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY departure_epoch, route_short_name,
    trip_id, stop_sequence, stop_id, service_date, headsign)::INTEGER AS rank,
  count(*) OVER (PARTITION BY query_id) AS total FROM board_hits"""

# Views holding a local instant per query or page are added by the oracle module.


def sql(body: str) -> str:
    """``body`` with the views it (transitively) names as a WITH list."""
    needed: list[str] = []

    def add(text: str, path: tuple[str, ...] = ()) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in path and name not in needed:
                add(VIEWS[name], (*path, name))
                needed.append(name)

    add(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    return f"WITH {ctes}\n{body}"
