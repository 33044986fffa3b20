"""The line contract: golden lines, the parser's cases and the places JSON readers are lax."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import batches, event_line
from pyspark.sql import functions as F

from runtally.functions import text, wire

# Two golden lines and the keys of the batches made of the first, and of both.
LINE_ONE = (
    '{"schemaVersion":1,"timestamp":"2026-06-28T12:34:56.789+00:00","installId":"11111111-2222-3333-4444-555555555555",'
    '"toolVersion":"1.0.0","engineVersion":"1.0.0","dotnetVersion":".NET 8.0.7","runCount":1,"scenarioCount":2,'
    '"stepVerdicts":{"pass":5,"fail":1,"envError":0,"inconclusive":0},'
    '"scenarioVerdicts":{"pass":2,"fail":0,"envError":0,"inconclusive":0},'
    '"stepFamilies":{"http":3,"db-assert":1,"custom":1},"stepProviders":{"http.rest":3,"db-assert.postgres":1,"custom":1},'
    '"startupMs":1234,"timeToFirstTestMs":1500}'
)
LINE_TWO = (
    '{"schemaVersion":1,"timestamp":"2026-06-28T13:00:00+00:00","installId":"aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee",'
    '"toolVersion":"1.0.0","engineVersion":"1.0.0","dotnetVersion":".NET 8.0.7","runCount":1,"scenarioCount":1,'
    '"stepVerdicts":{"pass":1,"fail":0,"envError":0,"inconclusive":0},'
    '"scenarioVerdicts":{"pass":1,"fail":0,"envError":0,"inconclusive":0},'
    '"stepFamilies":{"mq-publish":1},"stepProviders":{"mq-publish.kafka":1},"startupMs":900,"timeToFirstTestMs":950}'
)
KEY_ONE = "b06e845052ae47185c3c666dc711774de331bca3ef0812086cbd69caa8ee256e"
KEY_BOTH = "420f4b94a35bca1d0ce5e275a1cac904fdbf6186ee15853948d01161983500f8"


def check(spark, lines):
    df = spark.createDataFrame([(list(lines),)], "l array<string>")
    return df.select(F.inline(wire.checked_lines("l"))).collect()


def swap(old: str, new: str, line: str = LINE_ONE) -> str:
    assert old in line
    return line.replace(old, new)


def test_golden_values(spark):
    one, two = (row["event"] for row in check(spark, [LINE_ONE, LINE_TWO]))
    assert one["install_id"] == "11111111-2222-3333-4444-555555555555"
    assert one["event_timestamp"] == datetime(2026, 6, 28, 12, 34, 56, 789000)
    assert (one["schema_version"], one["run_count"], one["scenario_count"]) == (1, 1, 2)
    assert (one["step_pass"], one["step_fail"], one["scenario_pass"]) == (5, 1, 2)
    assert one["step_families"] == {"http": 3, "db-assert": 1, "custom": 1}
    assert one["step_providers"] == {"http.rest": 3, "db-assert.postgres": 1, "custom": 1}
    assert (one["startup_ms"], one["time_to_first_test_ms"]) == (1234, 1500)
    assert two["step_providers"] == {"mq-publish.kafka": 1}


def test_golden_round_trip_and_keys(spark):
    df = spark.createDataFrame([([LINE_ONE, LINE_TWO],)], "l array<string>")
    encoded = df.select(F.inline(wire.checked_lines("l"))).select("event.*").select(wire.encode_event().alias("line"))
    assert [row["line"] for row in encoded.collect()] == [LINE_ONE, LINE_TWO]
    bodies = batches(spark, (1, [LINE_ONE]), (2, [LINE_ONE, LINE_TWO])).orderBy("idempotency_key")
    keys = [row[0] for row in bodies.select(text.batch_key(text.split_lines(F.col("body")))).collect()]
    assert keys == [KEY_ONE, KEY_BOTH]


FAULTS = {
    "not json": ("{not json}", "malformed_json"),
    "trailing text": (LINE_ONE + " trailing", "malformed_json"),
    "two objects": (LINE_ONE + "," + LINE_ONE, "malformed_json"),
    "closed bracket": (LINE_ONE + "] x", "malformed_json"),
    "closed bracket, forged tail": (LINE_ONE + ',{"toolVersion":"1"}] x', "malformed_json"),
    "single quotes": (LINE_ONE.replace('"', "'"), "malformed_json"),
    "bare number": ("5", "malformed_json"),
    "bare null": ("null", "malformed_json"),
    "array": ("[]", "malformed_json"),
    "NaN": (swap('"startupMs":1234', '"startupMs":NaN'), "malformed_json"),
    "trailing comma": (LINE_ONE[:-1] + ",}", "malformed_json"),
    "no version": ('{"timestamp":"2026-01-01T00:00:00Z"}', "missing_schema_version"),
    "version as text": (swap('"schemaVersion":1,', '"schemaVersion":"one",'), "schema_version_not_integer"),
    "version as digits": (swap('"schemaVersion":1,', '"schemaVersion":"1",'), "schema_version_not_integer"),
    "version 1.0": (swap('"schemaVersion":1,', '"schemaVersion":1.0,'), "schema_version_not_integer"),
    "version beyond int": (swap('"schemaVersion":1,', '"schemaVersion":3000000000,'), "schema_version_not_integer"),
    "version null": (swap('"schemaVersion":1,', '"schemaVersion":null,'), "schema_version_not_integer"),
    "version 0": (swap('"schemaVersion":1,', '"schemaVersion":0,'), "schema_version_below_one"),
    "version -1": (swap('"schemaVersion":1,', '"schemaVersion":-1,'), "schema_version_below_one"),
    "missing field": (swap('"toolVersion":"1.0.0",', ""), "missing_field"),
    "missing map": (swap('"stepFamilies":{"http":3,"db-assert":1,"custom":1},', ""), "missing_field"),
    "other case": (swap('"toolVersion"', '"ToolVersion"'), "missing_field"),
    "unknown field": (swap('"schemaVersion":1,', '"schemaVersion":1,"surprise":"x",'), "unknown_field"),
    "unknown verdict": (swap('"pass":5', '"skipped":1,"pass":5'), "unknown_field"),
    "null text": (swap('"toolVersion":"1.0.0"', '"toolVersion":null'), "null_required"),
    "number for text": (swap('"toolVersion":"1.0.0"', '"toolVersion":1'), "wrong_type"),
    "text for int": (swap('"runCount":1', '"runCount":"1"'), "wrong_type"),
    "fraction for int": (swap('"runCount":1', '"runCount":1.5'), "wrong_type"),
    "int overflow": (swap('"runCount":1', '"runCount":3000000000'), "wrong_type"),
    "long overflow": (swap('"startupMs":1234', '"startupMs":9223372036854775808'), "wrong_type"),
    "null int": (swap('"runCount":1', '"runCount":null'), "wrong_type"),
    "null verdicts": (swap('{"pass":5,"fail":1,"envError":0,"inconclusive":0}', "null"), "wrong_type"),
    "verdict text": (swap('"pass":5', '"pass":"5"'), "wrong_type"),
    "verdict null": (swap('"pass":5', '"pass":null'), "wrong_type"),
    "null map": (swap('{"http":3,"db-assert":1,"custom":1}', "null"), "wrong_type"),
    "map of text": (swap('"http":3', '"http":"3"'), "wrong_type"),
    "map with null": (swap('"http":3', '"http":null'), "wrong_type"),
    "id without hyphens": (swap("11111111-2222-3333-4444-555555555555", "11111111222233334444555555555555"), "bad_install_id"),
    "id in braces": (swap("11111111-2222-3333-4444-555555555555", "{11111111-2222-3333-4444-555555555555}"), "bad_install_id"),
    "time with a space": (swap("2026-06-28T12", "2026-06-28 12"), "bad_timestamp"),
    "hour only": (swap("T12:34:56.789+00:00", "T12"), "bad_timestamp"),
    "hour 25": (swap("T12:34", "T25:34"), "bad_timestamp"),
    "day 31 of june": (swap("2026-06-28", "2026-06-31"), "bad_timestamp"),
}


TWICE = {
    '"runCount":1': ['"runCount":"x"', '"runCount":9000000000', '"runCount":null'],
    '"startupMs":1234': ['"startupMs":1.5', '"startupMs":"1"', '"startupMs":9223372036854775808'],
    '"toolVersion":"1.0.0"': ['"toolVersion":7', '"toolVersion":null', '"toolVersion":["1"]'],
    '"stepFamilies":{"http":3,"db-assert":1,"custom":1}': ['"stepFamilies":[1]', '"stepFamilies":{"a":"1"}', '"stepFamilies":null'],
    '"stepVerdicts":{"pass":5,"fail":1,"envError":0,"inconclusive":0}': ['"stepVerdicts":5', '"stepVerdicts":{"pass":"1"}'],
    '"schemaVersion":1': ['"schemaVersion":"1"'],
}


def test_each_value_of_a_repeated_property_is_checked(spark):
    lines = []
    for right, wrongs in TWICE.items():
        assert right in LINE_ONE
        for wrong in wrongs:
            lines += [swap(right, f"{right},{wrong}"), swap(right, f"{wrong},{right}")]
    assert all(row["fault"] for row in check(spark, lines))
    twice = [swap(right, f"{right},{right}") for right in TWICE]
    assert [row["fault"] for row in check(spark, twice)] == [None] * len(twice)


def test_depth(spark):
    lines = []
    for arrays, text in ((63, ""), (64, ""), (20, "[{" * 60), (63, '\\"[[')):
        extra = f'"text":"{text}","deep":{"[" * arrays}{"]" * arrays},'
        lines.append(swap('"schemaVersion":1,', f'"schemaVersion":2,{extra}'))
    assert [row["fault"] for row in check(spark, lines)] == [None, "malformed_json", None, None]


def test_every_fault_is_named(spark):
    lines = [line for line, _ in FAULTS.values()]
    found = {name: row["fault"] for name, row in zip(FAULTS, check(spark, lines))}
    assert found == {name: fault for name, (_, fault) in FAULTS.items()}


def test_accepted_variations(spark):
    lines = {
        "lenient v2": swap('"schemaVersion":1,', '"schemaVersion":2,"futureField":{"a":[1]},'),
        "lenient v2 verdict": swap('"pass":5', '"skipped":"x","pass":5', swap('"schemaVersion":1,', '"schemaVersion":2,')),
        "missing verdict member": swap('"pass":5,"fail":1,"envError":0,"inconclusive":0', '"fail":1'),
        "empty maps": swap('{"http":3,"db-assert":1,"custom":1}', "{}"),
        "upper-case id": swap("aaaaaaaa-bbbb", "AAAAAAAA-BBBB", LINE_TWO),
        "surrounding space": "  " + LINE_ONE + "\t",
        "other order": '{"startupMs":1234,' + swap('"startupMs":1234,', "")[1:],
        "repeated map key": swap('"http":3', '"http":9,"http":3'),
        "repeated verdict": swap('"pass":5', '"pass":9,"pass":5'),
        "escaped text": swap('"toolVersion":"1.0.0"', '"toolVersion":"1.0\\u002e0"'),
    }
    rows = dict(zip(lines, check(spark, lines.values())))
    assert {name: row["fault"] for name, row in rows.items()} == dict.fromkeys(lines)
    events = {name: row["event"] for name, row in rows.items()}
    assert events["lenient v2"]["schema_version"] == 2
    assert (events["missing verdict member"]["step_pass"], events["missing verdict member"]["step_fail"]) == (0, 1)
    assert events["upper-case id"]["install_id"] == "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"
    assert events["repeated map key"]["step_families"] == {"db-assert": 1, "http": 3, "custom": 1}
    assert events["repeated verdict"]["step_pass"] == 5
    assert events["escaped text"]["tool_version"] == "1.0.0"


@pytest.mark.parametrize(
    ("sent", "instant"),
    [
        ("2026-06-28T12:34:56Z", datetime(2026, 6, 28, 12, 34, 56)),
        ("2026-06-28T12:34:56.1234567+00:00", datetime(2026, 6, 28, 12, 34, 56, 123456)),
        ("2026-06-28T12:34:56.1234567890123456Z", datetime(2026, 6, 28, 12, 34, 56, 123456)),
        ("2026-06-28T02:00:00+05:30", datetime(2026, 6, 27, 20, 30)),
        ("2026-06-28T02:00:00-03", datetime(2026, 6, 28, 5, 0)),
        ("2026-06-28T02:00Z", datetime(2026, 6, 28, 2, 0)),
        ("2026-06-28T02:00:00.5", datetime(2026, 6, 28, 2, 0, 0, 500000)),
        ("2026-06-28", datetime(2026, 6, 28)),
        ("2026-06-28T02:00:00+15:00", None),
        ("2026-06-28T02:00:00+14:00", datetime(2026, 6, 27, 12, 0)),
        ("2026-06-28T02:00:00-14", datetime(2026, 6, 28, 16, 0)),
        ("2026-06-28T02:00:00+13:59", datetime(2026, 6, 27, 12, 1)),
        ("2026-06-28T02:00:00+14:01", None),
        ("2026-06-28T02:00:00-14:59", None),
        ("2026-06-28Z", None),
        ("20260628T020000Z", None),
        ("2026-06-28T02:00:00.Z", None),
        ("2026-06-28T02:00:00z", None),
    ],
)
def test_timestamps(spark, sent, instant):
    row = check(spark, [event_line(at=sent)])[0]
    assert (row["fault"] is None) == (instant is not None)
    if instant:
        assert row["event"]["event_timestamp"] == instant


def test_lines_of_the_frozen_form_give_what_the_whole_chain_gives(spark):
    frozen = [
        LINE_ONE, LINE_TWO, swap("06-28", "02-30"), swap("T12", "T25"), swap("+00:00", "+14:00"), swap("+00:00", "Z"),
        swap('"http":3,"db', '"http":3,"http":9,"db'), swap('{"http":3,"db-assert":1,"custom":1}', "{}"),
        swap('"startupMs":1234', '"startupMs":999999999999999999'), swap("5555", "ABCD"),
        swap('{"http":3,', "{" + "".join(f'"k{i}":{i},' for i in range(20000))),
    ]
    others = [
        "{not", "null", "", None, LINE_ONE + " x", LINE_ONE + "," + LINE_TWO, swap('"1.0.0"', '"1.0.\\u0030"'), swap("1.0.0", "é"),
        swap('"pass":5,', ""), swap('"pass":5', '"pass":05'), swap('"runCount":1', '"runCount":3000000000'), swap("2026", "0000"), swap(".NET", "\x01" * 19),
        swap('"http":3', '"http,x:y":3'),
        swap("+00:00", "+14:30"), swap("+00:00", ""), swap(".789", ".7891234"), swap(":1}", ":null}"), swap('"runCount":1,', ""),
        swap('"startupMs":1234', '"startupMs":12345678901234567890'), swap('"runCount":1', '"runCount":1,"runCount":1'),
    ]
    df = spark.createDataFrame([(frozen + others,), ([],), (None,), (others,)], "l array<string>")
    for row in df.select(wire.checked_lines("l").alias("new"), F.expr(wire._checked_by_chain("l")).alias("old")).collect():
        assert row["new"] == row["old"]
    lines = spark.createDataFrame([(line,) for line in frozen + others], "l string")
    told = [row[0] for row in lines.select(F.expr(f"l rlike r'{wire._frozen_line()}'")).collect()]
    assert told == [True] * len(frozen) + [None if line is None else False for line in others]
