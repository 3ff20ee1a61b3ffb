from __future__ import annotations

import datetime as dt
import random

import pytest

from conftest import collect
from folio.operators import ledger
from folio.streaming import live

COLUMNS = (
    "tenant_id string, action_id string, customer_id string, event_ts timestamp_ntz, event_seq bigint, event_type string, action_type string, "
    "payload_json string, status string, actor string, notes string, rationale string, confidence double, error string, customer_full_name string"
)


def event(seq, kind, action="A1", payload=None, status=None, error=None, action_type="send_email", tenant="t"):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq // 2)  # two events share an instant
    return (tenant, action, "C1", at, seq, kind, action_type, payload, status, "u", None, None, 0.5, error, "Ida Kern")


def replay(events):
    """One event at a time, as a mutable table would take them."""
    rows, trail = {}, []
    for e in sorted(events, key=lambda e: (e[3], e[4])):
        key = (e[0], e[1])
        if e[5] == "propose":
            rows.setdefault(key, {"payload": e[7], "status": "pending", "sent_at": None, "error": None})
        elif key not in rows:
            continue
        elif e[5] == "edit" and rows[key]["status"] == "pending":
            rows[key]["payload"] = e[7]
        elif e[5] == "decide":
            rows[key]["status"] = e[8]
            trail.append((*key, e[4]))
        elif e[5] == "send":
            rows[key]["sent_at"], rows[key]["error"] = (e[3] if e[13] is None else None), e[13]
    return rows, trail


def test_state_equals_a_replay_of_random_ledgers(spark):
    rng = random.Random(5)
    events = [
        event(i, rng.choice(["propose", "edit", "edit", "decide", "send"]), f"A{rng.randrange(12)}", rng.choice([None, f"p{i}"]),
              rng.choice(["approved", "rejected"]), rng.choice([None, "bad"]), tenant=rng.choice("tu")) for i in range(400)
    ]
    rng.shuffle(events)
    df = spark.createDataFrame(events, COLUMNS).repartition(6)
    want, trail = replay(events)
    got = {(r.tenant_id, r.action_id): r for r in ledger.action_state(df).collect()}
    assert set(got) == set(want)
    for key, row in want.items():
        seen = got[key]
        assert (seen.payload_json, seen.status, seen.sent_at, seen.send_error) == (row["payload"], row["status"], row["sent_at"], row["error"])
    decisions = ledger.decisions(df)
    assert sorted(trail) == sorted((t, a, int(d[4:])) for t, a, d in collect(decisions, "tenant_id", "related_action_id", "decision_id"))
    shown = ledger.decided_actions(ledger.action_state(df), decisions, 1000)
    assert shown.count() == len(trail)
    latest = ledger.decided_actions(ledger.action_state(df), decisions, 1000, latest_only=True)
    assert latest.count() == len({(t, a) for t, a, _ in trail})


@pytest.mark.parametrize("payload,want", [
    (None, "{}"), ("  ", "{}"), ('{"a":1}', '{"a":1}'), ("[1,2]", "[1,2]"), ("{bad", '{"text":"{bad"}'), ('say "hi"', '{"text":"say \\"hi\\""}'),
])
def test_payloads_become_json(spark, payload, want):
    who = spark.createDataFrame([("t", "C1", "Pat")], "tenant_id string, customer_id string, customer_full_name string")
    row = ledger.validate_proposals(spark.createDataFrame([event(1, "propose", payload=payload)], COLUMNS), who).collect()[0]
    assert (row.payload_json, row.accepted, row.reject_reason) == (want, True, None)


def test_rejected_proposals_say_why(spark):
    who = spark.createDataFrame([("t", "C1", "Pat")], "tenant_id string, customer_id string, customer_full_name string")
    bad = [event(1, "propose", action_type="delete"), event(2, "propose", action_type=None), event(3, "propose", tenant="u")]
    df = spark.createDataFrame([b[:12] + (c,) + b[13:] for b, c in zip(bad, (7.0, -1.0, None))], COLUMNS)
    got = {r.event_seq: (r.accepted, r.reject_reason, r.confidence) for r in ledger.validate_proposals(df, who).collect()}
    assert got == {1: (False, "unknown action type", 1.0), 2: (False, "unknown action type", 0.0), 3: (False, "unknown customer", 0.7)}


def test_email_checks(spark):
    cases = {"A1": '{"to":" a@b ","subject":"s"}', "A2": '{"subject":"s"}', "A3": '{"to":"nobody","subject":"s"}', "A4": '{"to":"a@b","subject":" "}', "A5": "{bad"}
    events = [e for i, (a, p) in enumerate(cases.items()) for e in (event(4 * i, "propose", a, p), event(4 * i + 2, "decide", a, status="approved"))]
    got = dict(collect(ledger.sendable_emails(ledger.action_state(spark.createDataFrame(events, COLUMNS))), "action_id", "reason"))
    assert got == {"A1": None, "A2": "no recipient", "A3": "recipient is not an address", "A4": "no subject", "A5": "payload is not JSON"}


def test_only_new_requests_are_asked_once(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", "y", 2), ("a", "z", None), ("b", "y", 2), ("b", "x", 1)]
    asked = spark.createDataFrame(rows, "tenant_id string, q string, n int")
    done = asked.filter("q = 'y' and tenant_id = 'a'").select("tenant_id", ledger.content_key("n", "q").alias("content_key"))
    got = collect(ledger.dedupe_requests(asked, done, ["q", "n"]), "tenant_id", "q", "asked")
    assert got == [("a", "x", 2), ("a", "z", 1), ("b", "x", 1), ("b", "y", 1)]


def test_only_approvals_and_rejections_decide(spark):
    events = [event(0, "propose", payload="p"), event(2, "decide", status="maybe"), event(4, "decide"), event(6, "edit", payload="q")]
    row = ledger.action_state(spark.createDataFrame(events, COLUMNS)).collect()[0]
    assert (row.status, row.payload_json, row.customer_full_name) == ("pending", "q", "Ida Kern")
    assert ledger.decisions(spark.createDataFrame(events, COLUMNS)).count() == 0


def random_ledger(seed, n, actions=7):
    rng = random.Random(seed)
    kinds = ["propose", "edit", "edit", "decide", "send"]
    return [
        event(i, rng.choice(kinds), f"A{rng.randrange(actions)}", rng.choice([None, f"p{i}"]), rng.choice(["approved", "rejected", "maybe", None]), rng.choice([None, "bad"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_lasting_events_give_the_state_of_all_whatever_comes_when(spark, seed):
    events = random_ledger(seed, 240, 12)
    random.Random(seed).shuffle(events)
    kept = spark.createDataFrame([], COLUMNS)
    for at in range(0, 240, 60):
        kept = ledger.lasting_events(kept.unionByName(spark.createDataFrame(events[at : at + 60], COLUMNS)))
        state = ledger.action_state(spark.createDataFrame(events[: at + 60], COLUMNS))
        assert collect(ledger.action_state(kept), *state.columns) == collect(state)
    assert kept.count() < 240


def test_stream_of_raw_events_equals_the_batch(spark, tmp_path):
    # events of any time in any batch: late edits, invalid decisions, proposals after their decisions
    events = random_ledger(9, 200)
    random.Random(2).shuffle(events)
    table = spark.createDataFrame(events, COLUMNS)
    source, sink = str(tmp_path / "source"), str(tmp_path / "sink")
    for at in range(0, 200, 50):  # four files arrive one after the other
        spark.createDataFrame(events[at : at + 50], COLUMNS).coalesce(1).write.mode("append").parquet(source)
    stream = live.read_stream(spark, source, table.schema, files_per_batch=1)
    query = live.stream_action_state(stream, sink, str(tmp_path / "log"))
    query.awaitTermination()
    state = ledger.action_state(table)
    assert collect(live.current_actions(spark, sink), *state.columns) == collect(state)
    assert live.action_table(spark, sink).through() == 3
    # a batch that is started again counts once
    live.ledger_writer(sink)(spark.createDataFrame(events[150:], COLUMNS), 3)
    assert collect(live.current_actions(spark, sink), *state.columns) == collect(state)


def test_a_batch_that_ended_between_its_two_tables_is_finished(spark, tmp_path, monkeypatch):
    events = random_ledger(3, 90)
    sink = str(tmp_path / "sink")
    write = live.ledger_writer(sink)
    write(spark.createDataFrame(events[:50], COLUMNS), 0)
    with monkeypatch.context() as m:
        m.setattr(live, "action_state", lambda events: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write(spark.createDataFrame(events[50:], COLUMNS), 1)
    assert (live.kept_events(spark, sink).through(), live.action_table(spark, sink).through()) == (1, 0)
    write(spark.createDataFrame(events[50:], COLUMNS), 1)
    state = ledger.action_state(spark.createDataFrame(events, COLUMNS))
    assert collect(live.current_actions(spark, sink), *state.columns) == collect(state)


def signal(i, day, word, key=None):
    return ("t", f"C{i % 3}", key or f"S{i}", word, dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=i % 24))


def test_sentiment_stream_counts_an_id_once_and_drops_late_rows(spark, tmp_path):
    schema = "tenant_id string, customer_id string, signal_id string, signal string, event_time timestamp"
    first = [signal(i, 0, "positive") for i in range(6)] + [signal(0, 0, "positive")] + [signal(7, 0, None)]
    second = [signal(i, 9, "angry") for i in range(6, 12)]
    third = [signal(i, 10, "meh") for i in range(12, 15)]  # the watermark takes effect one batch after it moved
    late = [signal(20, 0, "meh")]
    source = str(tmp_path / "source")
    for rows in (first, second, third, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = live.read_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
    live.stream_sentiment(stream, str(tmp_path / "sink"), str(tmp_path / "log")).awaitTermination()
    got = collect(live.daily_sentiment(spark, str(tmp_path / "sink")))
    want = collect(live.batch_sentiment(spark.createDataFrame(first + second + third, schema)))
    assert got == want and sum(r[6] for r in got) == 15
