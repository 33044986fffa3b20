"""Column functions over bodies, headers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_BLANK = r"(?U)\S"
HEX_KEY = r"^[0-9a-f]{64}\z"
GUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"

_GUID_STRUCTURE = (
    r"^\{0x[0-9a-f]{1,8},0x[0-9a-f]{1,4},0x[0-9a-f]{1,4},\{0x[0-9a-f]{1,2}(,0x[0-9a-f]{1,2}){7}\}\}\z"
)
_GUID_GROUPS = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(NON_BLANK), F.lit(False))


def split_lines(body: Column) -> Column:
    """Content lines of a batch, in order: CRLF tolerated, blank lines dropped."""
    text = F.regexp_replace(body, "^\ufeff", "")
    stripped = F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit("\r")))
    return F.filter(stripped, lambda line: line.rlike(NON_BLANK))


def batch_key(lines: Column) -> Column:
    """Lowercase SHA-256 of the content lines joined by a newline."""
    return F.sha2(F.array_join(lines, "\n"), 256)


def media_type(content_type: Column) -> Column:
    """Media type without parameters, lowercased; empty when the header is missing."""
    bare = F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))
    return F.lower(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""))


def is_media_type(content_type: Column, wanted: str) -> Column:
    return media_type(content_type) == wanted


def is_hex_key(key: Column) -> Column:
    return F.coalesce(key.rlike(HEX_KEY), F.lit(False))


def fits_body_limit(body: Column, limit: int) -> Column:
    return F.coalesce(F.octet_length(body) <= limit, F.lit(True))


def redact_install_id(install_id: Column) -> Column:
    """First eight characters and an ellipsis: enough for a log line."""
    return F.when(F.length(install_id) > 8, F.concat(F.substring(install_id, 1, 8), F.lit("…"))).otherwise(
        install_id
    )


def token_list(csv: Column) -> Column:
    """Comma-separated tokens, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(csv, ","), lambda t: F.trim(t)), lambda t: t != "")


def bearer_token(header: Column) -> Column:
    """Token of a ``Bearer`` header (scheme in any case); null when there is none."""
    token = F.regexp_extract(header, r"(?is)^bearer (.+)\z", 1)
    return F.nullif(token, F.lit(""))


def canonical_guid(text: Column) -> Column:
    """Lowercase hyphenated form of a GUID given as 32 digits, hyphenated, hyphenated in
    braces or parentheses, or as a structure of hexadecimal numbers; null for anything else."""
    bare = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    inner = F.when(bare.rlike(r"^(\{.{36}\}|\(.{36}\))\z"), F.substring(bare, 2, 36)).otherwise(bare)
    packed = F.regexp_replace(bare, r"(?U)\s+", "")
    numbers = F.regexp_extract_all(packed, F.lit("0x([0-9a-f]+)"), 1)
    width = lambda i: F.when(i == 0, 8).when(i < 3, 4).otherwise(2)
    digits = F.when(bare.rlike(r"^[0-9a-f]{32}\z"), bare).when(
        packed.rlike(_GUID_STRUCTURE), F.array_join(F.transform(numbers, lambda n, i: F.lpad(n, width(i), F.lit("0"))), "")
    )
    dashed = F.concat_ws("-", *[F.substring(digits, start, size) for start, size in _GUID_GROUPS])
    return F.when(digits.isNotNull(), dashed).when(inner.rlike(GUID), inner)
