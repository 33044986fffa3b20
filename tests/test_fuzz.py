"""Randomly damaged lines against a plain-Python reading of the contract."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F
from test_wire import FAULTS, LINE_ONE, LINE_TWO

from runtally.functions import wire
from runtally.schema import VERDICT_FIELDS, WIRE_FIELDS

PIECES = [
    '"', "{", "}", "[", "]", ",", ":", " ", "0", "1", "-", ".", "e5", "null", "true", "NaN", "\\", "'", "\t", "é", "/**/", "",
    '"pass":', '"x":1,', '"schemaVersion":2,', '"runCount":7,', '"http":1,', "99999999999", "1.0", '""', "{}",
]


def is_int(value, bits):
    return type(value) is int and -(2 ** (bits - 1)) <= value < 2 ** (bits - 1)


def refuse(_):
    raise ValueError("not JSON")


class Pairs(dict):
    """An object that remembers every occurrence of its keys."""

    def __init__(self, pairs):
        super().__init__(pairs)
        self.pairs = pairs


def fits(name, value, strict) -> bool:
    if name in ("stepVerdicts", "scenarioVerdicts"):
        if not isinstance(value, dict) or (strict and set(value) - set(VERDICT_FIELDS)):
            return False
        return all(is_int(value[m], 32) for m in VERDICT_FIELDS if m in value)
    if name in ("stepFamilies", "stepProviders"):
        return isinstance(value, dict) and all(is_int(v, 32) for v in value.values())
    if name in ("timestamp", "installId", "toolVersion", "engineVersion", "dotnetVersion"):
        return isinstance(value, str)
    if name in ("schemaVersion", "runCount", "scenarioCount"):
        return is_int(value, 32)
    return name not in ("startupMs", "timeToFirstTestMs") or is_int(value, 64)


def acceptable(line: str) -> bool:
    """The contract over Python's own strict JSON reader; every value of a repeated property
    must fit, and the last one counts."""
    try:
        doc = json.loads(line, parse_constant=refuse, object_pairs_hook=Pairs)
    except ValueError:
        return False
    if isinstance(doc, Pairs) and len(doc.pairs) > len(doc):
        if not all(fits(name, value, doc.get("schemaVersion") == 1) for name, value in doc.pairs):
            return False
    if not isinstance(doc, dict) or not is_int(doc.get("schemaVersion"), 32) or doc["schemaVersion"] < 1:
        return False
    strict = doc["schemaVersion"] == 1
    if not set(WIRE_FIELDS) <= set(doc) or (strict and set(doc) - set(WIRE_FIELDS)):
        return False
    for name in ["stepVerdicts", "scenarioVerdicts"]:
        counts = doc[name]
        if not isinstance(counts, dict) or (strict and set(counts) - set(VERDICT_FIELDS)):
            return False
        if not all(is_int(counts[m], 32) for m in VERDICT_FIELDS if m in counts):
            return False
    for name in ["stepFamilies", "stepProviders"]:
        if not isinstance(doc[name], dict) or not all(is_int(v, 32) for v in doc[name].values()):
            return False
    texts = ["timestamp", "installId", "toolVersion", "engineVersion", "dotnetVersion"]
    if not all(isinstance(doc[name], str) for name in texts):
        return False
    if not all(is_int(doc[n], b) for n, b in [("runCount", 32), ("scenarioCount", 32), ("startupMs", 64), ("timeToFirstTestMs", 64)]):
        return False
    return bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", doc["installId"]))


TWICE = ['"runCount":1', '"runCount":"x"', '"startupMs":2.5', '"startupMs":7', '"toolVersion":"z"', '"toolVersion":1',
         '"stepVerdicts":{}', '"stepVerdicts":4', '"stepFamilies":{"q":1}', '"stepFamilies":[2]']


def damage(rng: random.Random) -> str:
    line = rng.choice([LINE_ONE, LINE_TWO])
    if rng.random() < 0.2:
        again = rng.choice(TWICE)
        return line[:-1] + "," + again + "}" if rng.random() < 0.5 else "{" + again + "," + line[1:]
    for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
        at = rng.randrange(len(line) + 1)
        action = rng.randrange(4)
        if action == 0:
            line = line[:at] + rng.choice(PIECES) + line[at:]
        elif action == 1:
            line = line[:at] + line[at + rng.randrange(1, 4) :]
        elif action == 2:
            line = line[:at] + rng.choice(PIECES) + line[at + 1 :]
        else:
            other = rng.randrange(len(line) + 1)
            line = line[: min(at, other)] + line[max(at, other) :]
    return line.replace("\n", " ")


def test_damaged_lines(spark):
    rng = random.Random(11)
    lines = [damage(rng) for _ in range(6000)] + [line for line, _ in FAULTS.values()]
    df = spark.createDataFrame([(i, [line]) for i, line in enumerate(lines)], "i int, l array<string>")
    found = {
        r["i"]: r["fault"] for r in df.repartition(8).select("i", F.inline(wire.checked_lines("l"))).collect()
    }
    assert len(found) == len(lines)
    wrong = []
    for i, line in enumerate(lines):
        # Dates are tested on their own; they are checked last.
        if found[i] != "bad_timestamp" and (found[i] is None) != acceptable(line):
            wrong.append((found[i], line))
    assert not wrong, wrong[:5]
    assert sum(fault is None for fault in found.values()) > 1000
