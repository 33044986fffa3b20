import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from runtally.llm import conversations

from .twins import assert_twin

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    out = {}
    for c in original:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))  # the remainder has the sign of c, as in SQL
        out[c] = tuple(original.get(base, [])[:h] + original[c][h:])
    return out


def brute(built):
    members, children, memo, out = defaultdict(list), defaultdict(set), {}, []
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    for node in sorted(members, key=len, reverse=True):
        held = members[node]
        leaves = sum(memo[k][0] for k in children[node]) if children[node] else 1
        saved = sum(memo[k][1] for k in children[node]) + ((len(held) - 1) * len(node[-1][1]) if node else 0)
        memo[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(held) if len(built[c]) == len(node))
        digest = hashlib.sha256(ends.encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children[node]), leaves, saved, digest))
    return sorted(out, key=repr)


def trie_of(df, width=conversations.BLOCK):
    found = conversations.trie(conversations.rebuilt(conversations.numbered(df)), width)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Shared beginnings, copies, long conversations, nulls, empty texts, repeated rows."""
    rnd = random.Random(11)
    out = []
    for c in [*range(0, 60), *range(95, 130), 200, 301, 40_000, 45_017, -3]:
        for t in range(rnd.choice([1, 2, 3, 4, 7, 9, 20])):
            out.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["", "a", "bb", "größe"])))
    for c in (500, 501, 599):
        out += [(c, t, "user", f"long {t % 3}") for t in range(67)]
    out += [(700, None, None, "first"), (700, 0, "user", None), (700, 1, None, None), (None, 0, "user", "x")]
    out += [(701, 0, "user", "twice"), (701, 0, "user", "twice")]
    out += [(c, 0, "user", "same") for c in range(8000, 8040)]
    return out


@pytest.mark.parametrize("width", [1, 3, 8])
def test_trie_against_brute_force(spark, rows, width):
    assert trie_of(spark.createDataFrame(rows, SCHEMA), width) == brute(rebuild(rows))


def test_turnless_conversations_end_at_the_root(spark):
    # a conversation with one turn whose first h >= 1 turns are taken from an absent one
    one = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(one, 0, "user", "gone"), (250, 0, "user", "x")]
    got = trie_of(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rebuild(rows))
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(100, 0, "user", t) for t in ("a", "b", "c")]
    assert trie_of(spark.createDataFrame(rows, SCHEMA)) == trie_of(spark.createDataFrame(rows[::-1], SCHEMA))


def test_empty_table_and_other_columns(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie_of(empty) == []
    some = spark.createDataFrame(rows[:40], SCHEMA)
    clash = some.withColumns({c: F.lit("x") for c in ("pos", "a", "block", "depth", "t1")})
    assert trie_of(clash) == trie_of(some)


def test_rollup_is_the_plan_and_nothing_stays_but_the_result(spark, rows):
    turns = conversations.rebuilt(conversations.numbered(spark.createDataFrame(rows, SCHEMA)))
    nodes = conversations._rollup(conversations.blocks(turns), conversations.BLOCK, "count(1) AS n")
    assert "Expand" in nodes._jdf.queryExecution().executedPlan().toString()


def test_twin(spark):
    assert_twin(spark, "op11_trie", SMALL)
