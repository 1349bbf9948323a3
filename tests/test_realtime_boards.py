"""Realtime overlays and board comparison on the mini feed's morning."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.mini import queries, rows
from tramline.operators import boards, departures as dep, realtime as rt

MORNING = "2027-05-12T08:30:00+00:00"
DUE = int(datetime.fromisoformat("2027-05-12T08:40:00+00:00").timestamp())  # of c1 at the gate
TU = ("feed_id string, capture_id string, entity_pos bigint, trip_id string, start_date string, "
      "trip_relationship string, trip_delay int")
SU = ("feed_id string, capture_id string, entity_pos bigint, stu_pos int, stop_id string, "
      "stop_sequence string, relationship string, event_delay int, event_time bigint")
CAP = "feed_id string, capture_id string, fetched_epoch bigint"


def update(capture="x", pos=0, start="", relationship="SCHEDULED", delay=None):
    return ("M", capture, pos, "c1", start, relationship, delay)


def stop(delay=None, time=None, stop_id="gate", seq="10", pos=0, relationship="SCHEDULED"):
    return (pos, stop_id, seq, relationship, delay, time)


def overlaid(spark, feed, cases):
    """The 08:40 departure under each case's stop updates, each case a query a second
    later with a capture of its own."""
    first = int(datetime.fromisoformat("2027-05-12T08:29:01+00:00").timestamp())
    at = [datetime.fromtimestamp(first + i, timezone.utc).isoformat() for i in range(len(cases))]
    q = queries(spark, *[(str(i), "410", t, 60) for i, t in enumerate(at)])
    tus = [update(f"x{i}") for i in range(len(cases))]
    stus = [("M", f"x{i}", 0, *u) for i, case in enumerate(cases) for u in case]
    caps = [("M", f"x{i}", first + i) for i in range(len(cases))]
    out = rt.overlay(dep.departures(q, feed), q, spark.createDataFrame(tus, TU),
                     spark.createDataFrame(stus, SU), spark.createDataFrame(caps, CAP))
    got = {int(r.query_id): (r.status, r.delay_seconds, r.minutes_predicted)
           for r in out.filter("trip_id = 'c1'").collect()}
    return [got[i] for i in range(len(cases))]


def test_predictions(spark, feed):
    cases = {
        "late": ([stop(delay=240)], ("SCHEDULED", 240, 14)),
        "early": ([stop(delay=-300)], ("SCHEDULED", -300, 5)),
        "half a minute down to even": ([stop(delay=270)], ("SCHEDULED", 270, 14)),
        "half a minute up to even": ([stop(delay=330)], ("SCHEDULED", 330, 16)),
        "by time": ([stop(time=DUE + 120)], ("SCHEDULED", 120, 12)),
        "time before delay": ([stop(time=DUE - 120, delay=900)], ("SCHEDULED", -120, 8)),
        "absurd time": ([stop(time=DUE + 43_260)], ("IMPLAUSIBLE_DELAY", 43_260, None)),
        "absurd delay": ([stop(delay=-43_260)], ("IMPLAUSIBLE_DELAY", -43_260, None)),
        "nothing said": ([stop()], ("NO_PREDICTION", None, None)),
        "no data": ([stop(relationship="NO_DATA")], ("NO_DATA", None, None)),
        "skipped": ([stop(delay=60, relationship="SKIPPED")], ("SKIPPED", None, None)),
        "number only": ([stop(delay=180, stop_id="")], ("SCHEDULED", 180, 13)),
        "another stop": ([stop(delay=180, stop_id="hall", seq="20")], ("NO_DATA", None, None)),
        "sequence before stop": ([stop(delay=60, stop_id="hall"), stop(delay=600, seq="99", pos=1)], ("SCHEDULED", 60, 11)),
    }
    got = overlaid(spark, feed, [c for c, _ in cases.values()])
    assert dict(zip(cases, got)) == {k: want for k, (_, want) in cases.items()}


def overlay(spark, feed, tus, captures=(("M", "x", DUE - 7200),)):
    q = queries(spark, ("q", "410", MORNING, 60))
    out = rt.overlay(dep.departures(q, feed), q, spark.createDataFrame(tus, TU),
                     spark.createDataFrame([], SU), spark.createDataFrame(list(captures), CAP))
    return out.filter("trip_id = 'c1'").first()


def test_trip_updates(spark, feed):
    r = overlay(spark, feed, [update(delay=90)])
    assert (r.status, r.delay_seconds) == ("SCHEDULED", 90)
    r = overlay(spark, feed, [update(delay=90, relationship="CANCELED")])
    assert (r.realtime, r.status, r.predicted_epoch) == (True, "CANCELED", None)
    r = overlay(spark, feed, [update(delay=90, start="20270511")])
    assert (r.realtime, r.status) == (False, "SCHEDULED_ONLY")
    assert overlay(spark, feed, [update(delay=90), update(pos=3, delay=150)]).delay_seconds == 150


def test_newest_capture_known_at_the_time(spark, feed):
    at = DUE - 600
    tus = [update(c, delay=d) for c, d in (("old", 30), ("now", 90), ("later", 300))]
    caps = [("M", "old", at - 200_000), ("M", "now", at), ("M", "later", at + 1)]
    assert overlay(spark, feed, tus, caps).delay_seconds == 90
    assert overlay(spark, feed, tus, caps[:1]).delay_seconds == 30
    assert overlay(spark, feed, tus, caps[2:]).status == "SCHEDULED_ONLY"


def test_join_rate_is_unmeasured_without_trips(spark, feed):
    tus = spark.createDataFrame([("M", "x", i, t, "", "", 1) for i, t in enumerate(("c1", "h1", "s1", "bogus"))], TU)
    assert rt.join_rate(tus, feed.trips()).first().join_rate == 0.75
    assert rt.join_rate(tus.filter("false"), feed.trips()).count() == 0


def test_expected_board_orders_by_prediction_and_explains_empty(spark, feed):
    q = queries(spark, ("q", "410", MORNING, 60), ("none", "999", MORNING, 60))
    out = boards.expected_board(q, feed, spark.createDataFrame([update(delay=420)], TU),
                                spark.createDataFrame([], SU), spark.createDataFrame([("M", "x", DUE - 7200)], CAP))
    got = sorted(map(tuple, out.select("query_id", "position", "trip_id", "stop_code", "reason").collect()),
                 key=lambda r: (r[0], r[1] or 0))
    assert got == [("none", None, None, None, "STOP_NOT_FOUND"), ("q", 1, "h1", "410", None), ("q", 2, "c1", "410", None)]


SHOWN = {"route": "7", "route_id": "coast", "headsign": "Lighthouse", "departure": "2027-05-12T08:40:00+00:00",
         "stop_id": "gate", "stop_code": "410", "trip_id": "c1", "minutes_away": "10", "realtime": "false"}


def reconciled(spark, feed, *pairs):
    """Outcomes of each (expected, observed) pair of boards."""
    cols = sorted({*SHOWN, "board_id", "feed_id", "position"})
    schema = ", ".join(f"{c} {'int' if c == 'position' else 'string'}" for c in cols)

    def side(k):
        full = [{"feed_id": "M", "board_id": str(b), "position": i, **r}
                for b, pair in enumerate(pairs) for i, r in enumerate(pair[k])]
        return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in full], schema)

    got = {}
    for b, *rest in rows(boards.reconcile(side(0), side(1), feed.zones()), "board_id", "mode", "outcome", "differing"):
        got.setdefault(int(b), []).append(tuple(rest))
    return [got[b] for b in range(len(pairs))]


def test_reconcile(spark, feed):
    same = ("trip_id", "matched", "")
    cases = [
        ([SHOWN], [same]),
        ([{**SHOWN, "headsign": "LIGHTHOUSE "}], [same]),
        ([{**SHOWN, "minutes_away": "10.0", "realtime": "FALSE"}], [same]),
        ([{**SHOWN, "route": "coast"}], [same]),
        ([{**SHOWN, "stop_id": "410"}], [same]),
        ([{**SHOWN, "departure": "2027-05-12T09:40:00+01:00"}], [same]),
        ([{**SHOWN, "route": "8", "route_id": None}], [("trip_id", "differing", "route")]),
        ([{**SHOWN, "departure": "8:43"}], [("trip_id", "differing", "departure")]),
        ([{**SHOWN, "trip_id": None}], [("departure_route", "matched", "")]),
        ([{**SHOWN, "trip_id": None, "route": None, "route_id": None}], [("departure", "matched", "")]),
        ([{**SHOWN, "departure": "due", "trip_id": None}], [("position", "differing", "departure")]),
        ([], [("departure", "missing", "")]),
        ([SHOWN, {**SHOWN, "trip_id": "h9"}], [("trip_id", "extra", ""), same]),
    ]
    assert reconciled(spark, feed, *[([SHOWN], observed) for observed, _ in cases]) == [want for _, want in cases]


def test_reconcile_pairs_repeats_in_order_and_past_midnight(spark, feed):
    night = {**SHOWN, "departure": "24:35:00", "trip_id": None}
    device = {**SHOWN, "departure": "2027-05-13T00:35:00+00:00", "trip_id": None}
    assert reconciled(spark, feed, ([night, night, night], [device])) == [[
        ("departure_route", "matched", ""), ("departure_route", "missing", ""), ("departure_route", "missing", "")]]


@pytest.mark.parametrize("chunk", [7, 40])
def test_occurrence_numbers_span_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(boards, "CHUNK", chunk)
    df = spark.range(81).select(F.lit("k").alias("k"), F.col("id").alias("p"))
    assert rows(boards._occurrence(df, ["k"], "p"), "p", "occurrence") == [(i, i + 1) for i in range(81)]
