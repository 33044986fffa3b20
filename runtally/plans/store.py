"""The event store: catalog tables, their views and their keyed state."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runtally.config import DEFAULT_SHARDS, Options, validate_options
from runtally.operators import rollups
from runtally.operators.dedup import install_shard
from runtally.operators.forget import forget_state
from runtally.schema import DEFAULT_PART, GENERATION_PROPERTY, SHARDS_PROPERTY, TABLES

VIEWS = {
    "v_run_daily": rollups.run_daily,
    "v_step_family_daily": rollups.step_family_daily,
    "v_step_provider_daily": rollups.step_provider_daily,
}

#: The column of a table that single values are looked up by.
INDEXED = {"telemetry_event": "install_id"}

#: Names of the only time zone in which days, partitions and retention mean the same.
_UTC = {"UTC", "ETC/UTC", "UCT", "ETC/UCT", "GMT", "ETC/GMT", "ZULU", "Z", "UNIVERSAL", "+00:00", "UTC+00:00", "GMT+00:00"}


class Store:
    """Tables in one catalog database.

    One writer at a time: run ingest and maintenance of a store one after the other.
    Every step can be run again after a crash.
    """

    def __init__(self, spark: SparkSession, database: str, options: Options | None = None):
        self.spark = spark
        self.database = database
        self.options = validate_options(options or Options.from_session(spark))
        zone = spark.conf.get("spark.sql.session.timeZone")
        if zone.upper() not in _UTC:
            raise RuntimeError(f"the session's time zone must be UTC, not {zone}: see runtally.session.prepare")

    @property
    def install_shards(self) -> int:
        """The shard count that the event table was created with."""
        found = self._property("telemetry_event", SHARDS_PROPERTY)
        if not found:
            raise RuntimeError(f"{self.name('telemetry_event')} has no property {SHARDS_PROPERTY}: not a table of this store")
        given = self.options.install_shards
        if given is not None and given != found[0]:
            raise ValueError(f"the store has {found[0]} install shards, not {given}: use lifecycle.reshard to change them")
        return found[0]

    def _property(self, table: str, key: str) -> list[int]:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)}").collect()
        return [int(row["value"]) for row in rows if row["key"] == key]

    @property
    def generation(self) -> int:
        """The number that rows are stored with: how many erasures have begun before."""
        return max(self._property("erasure", GENERATION_PROPERTY), default=0)

    def begin_generation(self, number: int) -> None:
        """Rows stored from now on are not touched by the erasures so far."""
        self.spark.sql(f"ALTER TABLE {self.name('erasure')} SET TBLPROPERTIES ('{GENERATION_PROPERTY}' = '{number}')")

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def within(self, spark: SparkSession) -> Store:
        """The same store as seen by another session, such as that of a micro-batch."""
        return self if spark is self.spark else Store(spark, self.database, self.options)

    def refresh(self) -> Store:
        """List the tables' files anew, after another session or application wrote some."""
        for table in TABLES:
            self.spark.catalog.refreshTable(self.name(table))
        return self

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def create_tables(self, location: str | None = None) -> Store:
        quoted = (location or "").replace("\\", "\\\\").replace("'", "\\'")
        at = f" LOCATION '{quoted}'" if location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`{at}")
        for table in TABLES:
            self.create_table(table, table, self.options.install_shards or DEFAULT_SHARDS)
        self.install_shards  # noqa: B018 - refuse a count that differs from an existing store's
        return self

    def create_table(self, table: str, shape: str, shards: int) -> None:
        columns, parts = TABLES[shape]
        # An overwrite replaces the partitions it has rows for, never the whole table.
        options = {"partitionOverwriteMode": "dynamic"}
        if shape in INDEXED:  # row groups without the value are skipped, also where files overlap
            options |= {f"parquet.bloom.filter.enabled#{INDEXED[shape]}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        listed = ", ".join(f"'{key}' '{value}'" for key, value in options.items())
        how = f"OPTIONS ({listed}) PARTITIONED BY ({', '.join(parts)})" if parts else ""
        kept = f"TBLPROPERTIES ('{SHARDS_PROPERTY}' = '{shards}')" if shape == "telemetry_event" else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet {how} {kept}")

    # -- reads ---------------------------------------------------------------

    def visible(self, table: str, later: bool = False) -> DataFrame:
        """Rows of the event table or the ledger that no erasure covers.

        Tombstones are few, as compaction removes them with what they cover; Spark broadcasts
        them while their true size allows. ``later`` keeps them in the plan even if there are
        none now, for views that outlive this moment.
        """
        rows = self.table(table)
        if not later and not self.leaves("erasure"):
            return rows
        gone = self.table("erasure").select(F.col("install_id").alias("_erased"), F.col("upto").alias("_upto"))
        covered = (F.col("install_id") == F.col("_erased")) & (F.coalesce("generation", F.lit(-1)) <= F.col("_upto"))
        return rows.join(gone, covered, "left_anti")

    def ledger(self) -> DataFrame:
        """Batches that count as taken in."""
        return self.visible("ingest_batch")

    def events(self, first: date | None = None, last: date | None = None, later: bool = False) -> DataFrame:
        """Events of all partitions, or of the days ``first`` to ``last`` (inclusive).

        A day range prunes partitions; the default partition may hold any day.
        """
        rows = self.visible("telemetry_event", later)
        for bound, above in [(first, True), (last, False)]:
            if bound is None:
                continue
            day, part = F.to_date("event_timestamp"), f"{bound:%Y%m%d}"
            in_part = F.col("part") >= part if above else F.col("part") <= part
            rows = rows.where((F.col("part") == DEFAULT_PART) | in_part)
            rows = rows.where(day >= F.lit(bound) if above else day <= F.lit(bound))
        return rows

    def partition(self, part: str) -> DataFrame:
        """Rows of one day partition (``yyyyMMdd``) or of ``default``."""
        return self.visible("telemetry_event").where(F.col("part") == part)

    def registered_days(self) -> DataFrame:
        return (
            self.table("partition_log")
            .groupBy("day")
            .agg(F.max_by("active", "version").alias("active"))
            .where("active")
            .select("day")
        )

    def list_partitions(self) -> DataFrame:
        """Names of all partitions, the default one included."""
        days = self.registered_days().select(F.date_format("day", "yyyyMMdd").alias("part"))
        return days.unionByName(self.spark.range(1).select(F.lit(DEFAULT_PART).alias("part"))).orderBy("part")

    def forgets(self) -> DataFrame:
        return forget_state(self.table("forget_log"))

    def events_by_install(self, install_id: str) -> DataFrame:
        """The events of one install; only its shard is read, and of its files only row groups
        whose statistics, dictionary or Bloom filter may hold the install."""
        install = F.lit(install_id.lower())
        rows = self.visible("telemetry_event").where(F.col("install_id") == install)
        return rows.where(F.col("shard") == install_shard(self.install_shards, install))

    def events_with_day(self, first: date | None = None, last: date | None = None, later: bool = False) -> DataFrame:
        """Events with their ``day``, taken from the partition where it tells the day: a
        condition on the day then prunes partitions."""
        rows = self.events(first, last, later)
        named = rows.where(F.col("part") != DEFAULT_PART)
        named = named.withColumn("day", F.to_timestamp(F.to_date("part", "yyyyMMdd")))
        rest = rows.where(F.col("part") == DEFAULT_PART).withColumn("day", rollups.event_day())
        return named.unionAll(rest)

    def outcomes(self) -> DataFrame:
        """The recorded outcome of every batch arrival, once each."""
        return self.table("ingest_result").where(~F.col("replayed"))

    def create_views(self) -> None:
        """Dashboard views kept in the database, for every session that reads its catalog.

        They read the tables as they are when queried, without erased rows; a condition on
        ``day`` reads the partitions of those days and the default one. ``v_event`` is the
        event table with the ``day`` that the others group by.
        """
        named = "to_timestamp(to_date(part, 'yyyyMMdd'))"
        queries = {
            "v_event": f"""
                WITH kept AS (
                    SELECT e.* FROM {self.name("telemetry_event")} e LEFT ANTI JOIN {self.name("erasure")} x
                    ON e.install_id = x.install_id AND coalesce(e.generation, -1) <= x.upto
                )
                SELECT {named} AS day, * FROM kept WHERE part <> '{DEFAULT_PART}'
                UNION ALL
                SELECT date_trunc('day', event_timestamp) AS day, * FROM kept WHERE part = '{DEFAULT_PART}'"""
        }
        rows = self.name("v_event")
        queries["v_run_daily"] = rollups.run_daily_sql(rows)
        queries["v_step_family_daily"] = rollups.usage_daily_sql(rows, "step_families", "family")
        queries["v_step_provider_daily"] = rollups.usage_daily_sql(rows, "step_providers", "provider")
        for view, query in queries.items():
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(view)} AS {query}")

    def register_views(self, first: date | None = None, last: date | None = None) -> None:
        """The dashboard views as temporary ones of this session, over the whole store or a
        range of days; a condition on ``day`` prunes as in ``create_views``."""
        for view, rollup in VIEWS.items():
            rollup(self.events_with_day(first, last, later=True)).createOrReplaceTempView(view)

    # -- writes --------------------------------------------------------------

    def append(self, table: str, rows: DataFrame, into: str | None = None) -> None:
        """Append rows in the shape of ``table``, to it or to another table of that shape."""
        self._shaped(table, rows).write.insertInto(self.name(into or table))

    def replace_partitions(self, table: str, rows: DataFrame) -> None:
        """Overwrite the partitions that ``rows`` has rows for, and no others."""
        self._shaped(table, rows).write.insertInto(self.name(table), overwrite=True)

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """Columns in table order; partitions gathered into files of a sensible size.

        The rebalance lets Spark split a hot partition over tasks and merge small ones. Rows of
        an indexed table are sorted by the indexed column inside each partition's file, in the
        one sort that writing partitions takes anyway.
        """
        parts = TABLES[table][1]
        ordered = rows.select(*[column.split()[0] for column in TABLES[table][0].split(", ")])
        if parts:
            ordered = ordered.hint("rebalance", *[F.col(p) for p in parts])
        return ordered.sortWithinPartitions(*parts, INDEXED[table]) if table in INDEXED else ordered

    def drop_partitions(self, table: str, leaves: list[dict[str, object]]) -> None:
        """Drop storage partitions with their files, all in one catalog call."""
        specs = [
            "PARTITION (" + ", ".join(f"{name}='{value}'" for name, value in leaf.items()) + ")"
            for leaf in leaves
        ]
        if specs:
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS {', '.join(specs)}")

    def leaves(self, table: str) -> list[dict[str, str]]:
        """Storage partitions of a table, from the catalog alone."""
        rows = self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()
        return [dict(step.split("=", 1) for step in row[0].split("/")) for row in rows]

    def doomed(self, doomed, within: dict[str, Iterable] | None = None) -> DataFrame:
        """The visible events that ``doomed`` flags."""
        return doomed(self._within(self.visible("telemetry_event"), "telemetry_event", within)).where("_doomed")

    def doomed_days(self, doomed, within: dict[str, Iterable] | None = None) -> list[date]:
        """Days of the visible events that ``doomed`` flags: one value per calendar day."""
        rows = self.doomed(doomed, within)
        return sorted(r[0] for r in rows.select(F.to_date("event_timestamp")).distinct().collect())

    def _within(self, rows: DataFrame, table: str, within: dict[str, Iterable] | None) -> DataFrame:
        for column, values in (within or {}).items():
            if column not in TABLES[table][1]:
                raise ValueError(f"{column} is no partition column of {table}")
            rows = rows.where(F.col(column).isin(list(values)))
        return rows

    def delete_rows(self, table: str, doomed, within: dict[str, Iterable] | None = None) -> int:
        """Delete the rows for which ``doomed(df)`` adds a true ``_doomed`` flag.

        Parquet tables have no row delete: partitions that hold doomed rows are
        rewritten with the survivors, and those left with none are dropped, because an
        overwrite does not touch a partition it has no rows for. ``within`` narrows the
        search to values of partition columns. Returns the rows deleted.
        """
        parts = TABLES[table][1]
        source = self._within(self.table(table), table, within)

        def flag(rows: DataFrame) -> DataFrame:
            return doomed(rows).withColumn("_doomed", F.coalesce("_doomed", F.lit(False)))

        # One row per storage partition: bounded by days x shards, not by data.
        touched = (
            flag(source)
            .groupBy(*parts)
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_doomed")).alias("doomed"))
            .where("doomed > 0")
            .collect()
        )
        leaf = F.concat_ws("/", *[F.col(p).cast("string") for p in parts])
        partial = ["/".join(str(row[p]) for p in parts) for row in touched if row["doomed"] < row["total"]]
        if partial:
            survivors = flag(source.where(leaf.isin(partial))).where(~F.col("_doomed"))
            self.replace_partitions(table, survivors)
        emptied = [{p: row[p] for p in parts} for row in touched if row["doomed"] == row["total"]]
        self.drop_partitions(table, emptied)
        return sum(row["doomed"] for row in touched)

    def request_forget(self, requests: DataFrame) -> None:
        """Queue erasure requests ``(install_id, requested_at)``; a repeat reopens."""
        self.append("forget_log", requests.withColumn("processed_at", F.lit(None).cast("timestamp")))

    def copy_to(self, other: Store) -> Store:
        """Fill the empty tables of ``other`` with this store's rows, erased ones left out."""
        for table in ["telemetry_event", "ingest_batch"]:
            other.append(table, self.visible(table).withColumn("generation", F.lit(other.generation)))
        for table in ["forget_log", "partition_log"]:
            other.append(table, self.table(table))
        return other
