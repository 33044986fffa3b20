"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed (SHA-256 of its text). The ledger holds, per
blob, the rule versions it was scanned with and the findings. A scan reads only pairs of blob
and rule version that the ledger lacks, appends them, and joins the findings back to all
paths. Built-in functions only. A blob is scanned once, however many paths hold it.

Places come from ``split``: the lengths of the stretches between matches and of the matches
add up to starts and ends, in code points, end exclusive.

Defined results: a null text is the empty blob, which has no findings; repeated rows get one
row each; other columns are carried along, ``blob`` and ``findings`` replaced; a null path is
a path like any other; an empty table gives an empty table and adds nothing to the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runtally.session import materialize


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` of a match must have; a new version is scanned anew."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order that settles equal starts. Runs of one class are matched with their least
#: length at once: no shorter part of a run could match.
RULES = (
    Rule(
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
        r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("grant", r"gh[opsur]_[A-Za-z0-9]{36,}", base=False),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
)

#: A whole private key: the header, then all up to the END line (no other marker between, some
#: single hyphens for header fields), or, where that is missing, the header fields and lines of
#: base64 that follow. The longest keys have some 200 lines.
_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?:[^-]*-[^-]){0,32}?[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:\s{1,4}[A-Za-z0-9-]{1,40}:[^\r\n]{0,200}){0,8}"
    r"(?:(?:\s|\\[nr]){0,8}[A-Za-z0-9+/=]{40,}){1,256}(?:(?:\r?\n|\\n)[A-Za-z0-9+/=]+)?)?"
)
#: The rules of a redaction: the scan reports where a key starts, its replacement takes all of it.
REDACTED = tuple(replace(r, pattern=_KEY, version=2) if r.kind == "pem" else r for r in RULES)

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_LEDGER = f"blob string, rules array<string>, findings {_SPANS}"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule, leftmost and not overlapping, whose group is long enough."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = found if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.slice(between, 1, F.size(found)),
        F.zip_with(found, lengths, lambda m, g: F.struct(F.length(m).alias("all"), F.length(g).alias("part"))),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), m["all"].alias("all"), m["part"].alias("part")),
    )
    none = F.array().cast(_SPANS)
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["all"]).alias("at"),
            F.when(
                m["part"] >= rule.least,
                F.array_append(
                    acc["spans"],
                    F.struct(
                        (acc["at"] + m["gap"]).alias("start"),
                        F.lit(rank).alias("rank"),
                        (acc["at"] + m["gap"] + m["all"]).alias("end"),
                        F.lit(rule.kind).alias("kind"),
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .cast(_SPANS)
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(rule.pattern), walked).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, or None before its first scan."""
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``blob`` and ``findings`` (spans of all rules in order) to each version; scans what
    the ledger under the path ``ledger`` lacks and appends it there."""
    spark = versions.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("body"))
    blobs = blobs.groupBy("blob").agg(F.first("body").alias("body"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    past = read_ledger(spark, ledger)
    if past is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        # A blob has one row per scan that found new rule versions.
        done = past.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        todo = (
            blobs.join(done, "blob", "left")
            .withColumn("todo", F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, "done")))
            .where(F.size("todo") > 0)
        )
    found = [
        F.when(F.array_contains("todo", rule.key), spans(F.col("body"), rule, rank)).otherwise(F.array().cast(_SPANS))
        for rank, rule in enumerate(rules)
    ]
    todo.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("findings")).write.mode("append").parquet(
        ledger
    )
    # Findings of this rule set; a version that was replaced no longer counts.
    ranks = {rule.key: rank for rank, rule in enumerate(rules)}
    kinds = F.create_map(*(F.lit(x) for rule in rules for x in (rule.kind, ranks[rule.key])))
    current = F.filter(
        "findings",
        lambda s: F.exists("rules", lambda r: F.array_contains(wanted, r) & (F.split_part(r, F.lit("@"), F.lit(1)) == s["kind"])),
    )
    per_blob = (
        read_ledger(spark, ledger)
        .select("blob", F.explode(current).alias("s"))
        .select("blob", F.struct("s.start", kinds[F.col("s.kind")].alias("rank"), "s.end", "s.kind").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list("s")).alias("findings"))
    )
    per_blob = materialize(per_blob, "findings")
    paths = versions.drop("blob", "findings").withColumn("blob", F.sha2(body.cast("binary"), 256))
    joined = paths.join(per_blob, "blob", "left")
    return joined.withColumn("findings", F.coalesce("findings", F.array().cast(_SPANS)))


def joined_spans(findings: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, findings: Column) -> Column:
    """The text with every span replaced by its kind in brackets; what overlaps an earlier
    span is cut with it."""
    walked = F.aggregate(
        findings,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["text"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")
                ),
            )
            .otherwise(acc["text"])
            .alias("text"),
        ),
    )
    return F.concat(walked["text"], F.substring(text, walked["at"] + 1, F.length(text)))
