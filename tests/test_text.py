from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runtally.functions import text


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("body", "lines"),
    [
        ("a", ["a"]),
        ("a\n", ["a"]),
        ("a\nb", ["a", "b"]),
        ("a\r\nb\r\n", ["a", "b"]),
        ("a\r\r\nb", ["a", "b"]),
        ("a\n\n\nb", ["a", "b"]),
        ("a\n   \n\t\n b ", ["a", " b "]),
        ("﻿a\nb", ["a", "b"]),
        ("a\rb", ["a\rb"]),
        ("", []),
        (" \n \n", []),
    ],
)
def test_split_lines(spark, body, lines):
    assert one(spark, body, text.split_lines) == lines


@pytest.mark.parametrize(
    ("sent", "canonical"),
    [
        ("550e8400-e29b-41d4-a716-446655440000", "550e8400-e29b-41d4-a716-446655440000"),
        ("550E8400E29B41D4A716446655440000", "550e8400-e29b-41d4-a716-446655440000"),
        ("{550e8400-e29b-41d4-a716-446655440000}", "550e8400-e29b-41d4-a716-446655440000"),
        ("(550e8400-e29b-41d4-a716-446655440000)", "550e8400-e29b-41d4-a716-446655440000"),
        ("  550e8400-e29b-41d4-a716-446655440000\t", "550e8400-e29b-41d4-a716-446655440000"),
        ("{0x550e8400,0xE29B,0x41d4,{0xa7,0x16,0x44,0x66,0x55,0x44,0x0,0x00}}", "550e8400-e29b-41d4-a716-446655440000"),
        ("{0x1, 0x2, 0x3, {0x4,0x5,0x6,0x7,0x8,0x9,0xa,0xb}}", "00000001-0002-0003-0405-060708090a0b"),
        ("{0x1,0x2,0x3,{0x4,0x5,0x6,0x7,0x8,0x9,0xa}}", None),
        ("(550e8400-e29b-41d4-a716-446655440000}", None),
        ("{550e8400e29b41d4a716446655440000}", None),
        ("550e8400-e29b-41d4-a716-44665544000", None),
        ("550e8400-e29b-41d4-a716-44665544000g", None),
        ("", None),
        ("not-a-guid", None),
    ],
)
def test_canonical_guid(spark, sent, canonical):
    assert one(spark, sent, text.canonical_guid) == canonical


@pytest.mark.parametrize(
    ("header", "bare"),
    [
        ("application/x-ndjson", "application/x-ndjson"),
        (" Application/X-NDJSON ; charset=utf-8", "application/x-ndjson"),
        (None, ""),
        ("text/plain", "text/plain"),
    ],
)
def test_media_type(spark, header, bare):
    assert one(spark, header, text.media_type) == bare


@pytest.mark.parametrize(
    ("key", "ok"),
    [("a" * 64, True), ("A" * 64, False), ("a" * 63, False), ("a" * 65, False), ("a" * 64 + "\n", False), (None, False), ("", False)],
)
def test_hex_key(spark, key, ok):
    assert one(spark, key, text.is_hex_key) is ok


@pytest.mark.parametrize(
    ("header", "token"),
    [
        ("Bearer abc", "abc"),
        ("bEARER abc", "abc"),
        ("Bearer  abc", " abc"),
        ("Bearer ", None),
        ("Bearer", None),
        ("Basic abc", None),
        ("abc", None),
        (None, None),
    ],
)
def test_bearer_token(spark, header, token):
    assert one(spark, header, text.bearer_token) == token


def test_token_list_and_redaction(spark):
    assert one(spark, " a, b ,,c,", text.token_list) == ["a", "b", "c"]
    assert one(spark, "550e8400-e29b", text.redact_install_id) == "550e8400…"
    assert one(spark, "550e", text.redact_install_id) == "550e"
