"""SQL twins of the catalog queries, for an independent engine.

They reach each answer straight from the ``events`` table: which run survives, which
batch is refused or repeated and which request is turned away all follow from the user,
the day and the block, with no JSON read, no store and no Spark involved.
"""

from __future__ import annotations

# One row per run (user and day), with every wire value.
_RUNS = r"""
ev AS (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, event_type, value,
         event_type || '.p' || CAST(CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) % 3 AS VARCHAR) AS provider
  FROM events
),
agg AS (
  SELECT user_id, day, max(ts) AS ts,
         CAST(count(DISTINCT event_type) AS INTEGER) AS scenario_count,
         CAST(count(*) FILTER (event_type IN ('view', 'purchase')) AS INTEGER) AS step_pass,
         CAST(count(*) FILTER (event_type = 'click') AS INTEGER) AS step_fail,
         CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS step_env_error,
         CAST(count(*) FILTER (event_type = 'signup') AS INTEGER) AS step_inconclusive,
         CAST(count(DISTINCT event_type) FILTER (event_type IN ('view', 'purchase')) AS INTEGER) AS scenario_pass,
         CAST(count(DISTINCT event_type) FILTER (event_type = 'click') AS INTEGER) AS scenario_fail,
         CAST(count(DISTINCT event_type) FILTER (event_type = 'error') AS INTEGER) AS scenario_env_error,
         CAST(count(DISTINCT event_type) FILTER (event_type = 'signup') AS INTEGER) AS scenario_inconclusive,
         CAST(round(min(value) * 100) AS BIGINT) AS startup_ms,
         CAST(round(min(value) * 100) AS BIGINT) + CAST(round(max(value) * 10) AS BIGINT) AS time_to_first_test_ms
  FROM ev GROUP BY user_id, day
),
fam AS (SELECT user_id, day, event_type AS family, count(*) AS n FROM ev GROUP BY ALL),
prov AS (SELECT user_id, day, provider, count(*) AS n FROM ev GROUP BY ALL),
fam_json AS (
  SELECT user_id, day, '{' || string_agg('"' || family || '":' || n, ',' ORDER BY family) || '}' AS step_families
  FROM fam GROUP BY user_id, day
),
prov_json AS (
  SELECT user_id, day, '{' || string_agg('"' || provider || '":' || n, ',' ORDER BY provider) || '}' AS step_providers
  FROM prov GROUP BY user_id, day
),
runs AS (
  SELECT a.*, f.step_families, p.step_providers,
         CAST((a.day - DATE '2024-01-01') // 7 AS INTEGER) AS block,
         '00000000-0000-4000-8000-' || lpad(CAST(a.user_id AS VARCHAR), 12, '0') AS install_id,
         ts AS event_timestamp,
         CASE WHEN a.user_id % 10 = 9 THEN 2 ELSE 1 END AS schema_version,
         '1.' || (a.user_id % 4) || '.0' AS tool_version,
         '1.' || (a.user_id % 4) || '.0' AS engine_version,
         '.NET ' || (8 + a.user_id % 2) || '.0' AS dotnet_version,
         1 AS run_count
  FROM agg a JOIN fam_json f USING (user_id, day) JOIN prov_json p USING (user_id, day)
)"""

_LOST = """(user_id % 7 <> 0 AND (
    (user_id % 13 = 0 AND block = 1)
    OR (user_id % 13 = 0 AND block = 2 AND schema_version = 1)
    OR (user_id % 17 = 0 AND block = 3)))"""

# The stored events.
_STORED_RUNS = f"""stored AS (
  SELECT *, CASE WHEN day >= DATE '2024-01-10' THEN strftime(day, '%Y%m%d') ELSE 'default' END AS part
  FROM runs WHERE NOT {_LOST}
)"""
_STORED = f"{_RUNS}, {_STORED_RUNS}"


def _json_line(timestamp: str, version: str = "schema_version", extra: str = "''") -> str:
    iso = (
        f"strftime({timestamp}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN microsecond({timestamp}) % 1000000 = 0 THEN '' "
        f"ELSE '.' || rtrim(strftime({timestamp}, '%f'), '0') END || '+00:00'"
    )

    def verdicts(prefix: str) -> str:
        return (
            f"'{{\"pass\":' || {prefix}_pass || ',\"fail\":' || {prefix}_fail || ',\"envError\":' || "
            f"{prefix}_env_error || ',\"inconclusive\":' || {prefix}_inconclusive || '}}'"
        )

    return (
        f"""'{{"schemaVersion":' || {version} || ',"timestamp":"' || {iso} || '","installId":"' || install_id"""
        """ || '","toolVersion":"' || tool_version || '","engineVersion":"' || engine_version"""
        """ || '","dotnetVersion":"' || dotnet_version || '","runCount":' || run_count"""
        f""" || ',"scenarioCount":' || scenario_count || ',"stepVerdicts":' || {verdicts("step")}"""
        f""" || ',"scenarioVerdicts":' || {verdicts("scenario")}"""
        """ || ',"stepFamilies":' || step_families || ',"stepProviders":' || step_providers"""
        f""" || ',"startupMs":' || startup_ms || ',"timeToFirstTestMs":' || time_to_first_test_ms || {extra} || '}}'"""
    )


# Raw batches as sent, with their content key.
_BATCHES = f"""{_RUNS},
sent_lines AS (
  SELECT user_id, block, day, schema_version, sent_ts,
         {_json_line("sent_ts", extra="CASE WHEN user_id % 13 = 0 AND block = 2 THEN ',\"futureField\":1' ELSE '' END")} AS line,
         {_json_line("ts")} AS plain_line
  FROM (SELECT *, CASE WHEN user_id % 17 = 0 AND block = 3 THEN ts + INTERVAL 10 YEAR ELSE ts END AS sent_ts FROM runs)
),
weekly AS (
  SELECT user_id, block, max(schema_version) AS schema_version,
         string_agg(line, chr(10) ORDER BY sent_ts)
           || CASE WHEN user_id % 13 = 0 AND block = 1 THEN chr(10) || '{{not json}}' ELSE '' END AS body,
         count(*) + CASE WHEN user_id % 13 = 0 AND block = 1 THEN 1 ELSE 0 END AS n_lines
  FROM sent_lines GROUP BY user_id, block
),
batches AS (
  SELECT user_id, block, copy, schema_version, body, n_lines,
         TIMESTAMP '2024-01-01' + to_days(CAST((block + 1) * 7 AS INTEGER)) + to_seconds(user_id % 86400) + to_hours(copy) AS received_at
  FROM weekly, (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR user_id % 5 = 0
  UNION ALL
  SELECT user_id, -1, 2, max(schema_version), string_agg(plain_line, chr(10) ORDER BY day), count(*),
         TIMESTAMP '2024-01-01' + to_days(40) + to_seconds(user_id % 86400)
  FROM sent_lines WHERE user_id % 7 = 0 GROUP BY user_id
),
judged AS (
  SELECT *, sha256(body) AS idempotency_key, lpad(CAST(user_id AS VARCHAR), 12, '0') AS padded,
         CASE WHEN user_id % 13 = 0 AND block = 1 THEN 'malformed_json'
              WHEN user_id % 13 = 0 AND block = 2 AND schema_version = 1 THEN 'unknown_field'
              WHEN user_id % 17 = 0 AND block = 3 THEN 'future_timestamp' END AS reason,
         CASE WHEN user_id % 13 = 0 AND block = 1 THEN CAST(n_lines AS INTEGER)
              WHEN user_id % 13 = 0 AND block = 2 AND schema_version = 1 THEN 1 END AS bad_line
  FROM batches
),
-- Layer 1: the first accepted batch of every key.
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at) AS nth
    FROM judged WHERE reason IS NULL
  ) WHERE nth = 1
),
ledger AS (
  SELECT *, '00000000-0000-4000-8000-' || padded AS install_id, CAST(n_lines AS INTEGER) AS line_count FROM firsts
),
-- Layer 2: the first stored batch that carries a run.
carried AS (
  SELECT r.user_id, r.day, r.schema_version, r.install_id, r.ts, f.block, f.copy,
         row_number() OVER (PARTITION BY r.user_id, r.day ORDER BY f.received_at, f.idempotency_key) AS nth
  FROM firsts f JOIN runs r ON r.user_id = f.user_id AND (f.block = -1 OR f.block = r.block)
)"""

# The request log that is derived from the batches.
_HEADER = """CASE WHEN user_id % 37 = 1 THEN 'wrong' WHEN user_id % 37 = 2 THEN NULL
       ELSE 'token-' || chr(CAST(97 + user_id % 3 AS INTEGER)) END"""
_REQUESTS = f"""{_BATCHES},
posts AS (
  SELECT 'post-' || user_id || '-' || block || '-' || copy AS req_id, received_at AS ts, '/v1/telemetry' AS path,
         {_HEADER} AS token, user_id, block, copy, n_lines, reason AS content_fault, idempotency_key, schema_version,
         user_id % 19 <> 3 AS media_ok,
         user_id % 23 NOT IN (5, 6, 7) AS key_ok,
         user_id % 29 <> 3 AS size_ok,
         user_id % 29 <> 2 AS filled,
         CASE WHEN user_id % 29 = 2 THEN 0 ELSE n_lines END AS lines_sent
  FROM judged
),
users AS (SELECT DISTINCT user_id FROM batches),
forgets AS (
  SELECT 'forget-' || user_id AS req_id,
         TIMESTAMP '2024-01-01' + to_days(60) + to_seconds(user_id % 86400) AS ts, '/v1/telemetry/forget' AS path,
         {_HEADER} AS token, user_id, user_id % 5 <> 1 AS size_ok,
         CASE WHEN user_id % 3 <> 2 THEN '00000000-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') END AS install_id
  FROM users WHERE user_id % 11 = 0
),
probes AS (
  SELECT 'probe-' || user_id AS req_id,
         TIMESTAMP '2024-01-01' + to_days(7) + to_seconds(user_id % 86400) AS ts,
         CASE user_id % 4 WHEN 0 THEN '/healthz' WHEN 1 THEN '/readyz' WHEN 2 THEN '/' ELSE '/nowhere' END AS path,
         CAST(NULL AS VARCHAR) AS token
  FROM users
),
log AS (
  SELECT req_id, ts, path, token FROM posts
  UNION ALL SELECT req_id, ts, path, token FROM forgets
  UNION ALL SELECT req_id, ts, path, token FROM probes
),
keyed AS (
  SELECT *, coalesce(token IN ('token-a', 'token-b', 'token-c'), FALSE) AS known,
         CASE WHEN token IN ('token-a', 'token-b', 'token-c') THEN 'tok:' || upper(sha256(token))
              ELSE 'unauthenticated' END AS rate_key,
         floor(epoch(ts) / 60) AS minute,
         path IN ('/v1/telemetry', '/v1/telemetry/forget') AS policed
  FROM log
),
globally AS (
  SELECT *, row_number() OVER (PARTITION BY minute ORDER BY ts, req_id) AS nth FROM keyed
  WHERE path NOT IN ('/healthz', '/readyz')
),
per_key AS (
  SELECT *, row_number() OVER (PARTITION BY minute, rate_key ORDER BY ts, req_id) AS key_nth FROM globally
  WHERE nth <= 36 AND policed
),
admission AS (
  SELECT k.req_id, k.ts, k.path, k.known, k.policed,
         CASE WHEN k.path IN ('/healthz', '/readyz') THEN TRUE
              WHEN NOT k.policed THEN g.nth <= 36
              ELSE coalesce(p.key_nth <= 12, FALSE) END AS admitted
  FROM keyed k LEFT JOIN globally g USING (req_id) LEFT JOIN per_key p USING (req_id)
)"""

_EVENT_COLUMNS = """install_id, event_timestamp, schema_version, tool_version, engine_version, dotnet_version,
  run_count, scenario_count, step_pass, step_fail, step_env_error, step_inconclusive,
  scenario_pass, scenario_fail, scenario_env_error, scenario_inconclusive, startup_ms, time_to_first_test_ms,
  step_families, step_providers"""

_KIND = "CAST((user_id * 31 + day(day)) % 41 AS INTEGER)"
_MALFORMED = "(13, 14, 15, 23, 39)"
_REPEATED = "26, 27, 28, 29, 30, 31, 32, 33, 34, 35"


def _line_check(bad_kinds: str) -> str:
    return (
        f"WITH {_RUNS} SELECT user_id, day, {_KIND} NOT IN {_MALFORMED} AND {_KIND} NOT IN ({bad_kinds}) AS ok FROM runs"
    )


_FAULTS = f"""CASE
  WHEN {_KIND} IN {_MALFORMED} THEN 'malformed_json'
  WHEN {_KIND} = 1 THEN 'missing_schema_version'
  WHEN {_KIND} IN (2, 3) THEN 'schema_version_not_integer'
  WHEN {_KIND} = 4 THEN 'schema_version_below_one'
  WHEN {_KIND} = 5 THEN 'missing_field'
  WHEN {_KIND} IN (6, 7) THEN 'unknown_field'
  WHEN {_KIND} = 16 THEN 'null_required'
  WHEN {_KIND} IN (9, 10, 17, 18, 19, 22, {_REPEATED}) THEN 'wrong_type'
  WHEN {_KIND} = 11 THEN 'bad_install_id'
  WHEN {_KIND} IN (12, 25, 36, 37) THEN 'bad_timestamp' END"""

_DAILY = """
  SELECT date_trunc('day', event_timestamp) AS day, count(*) AS events,
         CAST(sum(run_count) AS BIGINT) AS runs, CAST(sum(scenario_count) AS BIGINT) AS scenarios,
         CAST(sum(step_pass) AS BIGINT) AS step_pass, CAST(sum(step_fail) AS BIGINT) AS step_fail,
         CAST(sum(step_env_error) AS BIGINT) AS step_env_error,
         CAST(sum(step_inconclusive) AS BIGINT) AS step_inconclusive,
         CAST(sum(scenario_pass) AS BIGINT) AS scenario_pass, CAST(sum(scenario_fail) AS BIGINT) AS scenario_fail,
         CAST(sum(scenario_env_error) AS BIGINT) AS scenario_env_error,
         CAST(sum(scenario_inconclusive) AS BIGINT) AS scenario_inconclusive,
         round(quantile_cont(startup_ms, 0.5), 6) AS startup_ms_p50,
         round(quantile_cont(startup_ms, 0.95), 6) AS startup_ms_p95,
         round(quantile_cont(time_to_first_test_ms, 0.5), 6) AS time_to_first_test_ms_p50,
         round(quantile_cont(time_to_first_test_ms, 0.95), 6) AS time_to_first_test_ms_p95,
         count(DISTINCT install_id) AS distinct_installs
  FROM stored GROUP BY 1"""

_FAMILY_DAILY = """SELECT CAST(s.day AS TIMESTAMP) AS day, family, CAST(sum(n) AS BIGINT) AS n
  FROM stored s JOIN fam USING (user_id, day) GROUP BY 1, 2"""
_PROVIDER_DAILY = """SELECT CAST(s.day AS TIMESTAMP) AS day, provider, CAST(sum(n) AS BIGINT) AS n
  FROM stored s JOIN prov USING (user_id, day) GROUP BY 1, 2"""

_ERASED = "(user_id % 11 = 0 AND user_id % 3 <> 2)"
_REQUESTED_AT = "TIMESTAMP '2024-01-01' + to_days(60) + to_seconds(user_id % 86400)"
_REOPENED = "user_id % 2 = 0"

# An erasure queue after all were served and every second one asked again.
_FORGET_STATE = f"""{_RUNS},
queue AS (
  SELECT DISTINCT install_id,
         CASE WHEN {_REOPENED} THEN TIMESTAMP '2024-05-01' ELSE {_REQUESTED_AT} END AS requested_at,
         CASE WHEN {_REOPENED} THEN NULL ELSE TIMESTAMP '2024-04-15' END AS processed_at
  FROM runs WHERE {_ERASED}
)"""

_PARTS = "SELECT part, count(*) AS rows, count(DISTINCT install_id) AS installs FROM stored"

_OUTCOME = """
answered AS (
  SELECT a.req_id, a.ts, a.path, p.idempotency_key, p.req_id IS NOT NULL AS is_post,
         CASE WHEN NOT a.admitted THEN 'rate_limited'
              WHEN a.policed AND NOT a.known THEN 'unauthenticated'
              WHEN p.req_id IS NOT NULL THEN
                CASE WHEN NOT media_ok THEN 'unsupported_media_type'
                     WHEN NOT key_ok THEN 'bad_idempotency_key'
                     WHEN NOT p.size_ok THEN 'body_too_large'
                     WHEN NOT filled THEN 'blank_body'
                     WHEN n_lines > 25 THEN 'too_many_lines'
                     ELSE content_fault END
              WHEN f.req_id IS NOT NULL THEN
                CASE WHEN NOT f.size_ok THEN 'body_too_large' WHEN f.install_id IS NULL THEN 'bad_install_id' END
              WHEN a.path = '/nowhere' THEN 'unknown_path' END AS reason
  FROM admission a LEFT JOIN posts p USING (req_id) LEFT JOIN forgets f USING (req_id)
),
known_keys AS (SELECT idempotency_key FROM ledger WHERE received_at < TIMESTAMP '2024-01-15'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY idempotency_key, is_post AND reason IS NULL ORDER BY ts, req_id) AS nth
  FROM answered
)
SELECT req_id, ts, path,
       CASE reason WHEN 'rate_limited' THEN 429 WHEN 'unauthenticated' THEN 401 WHEN 'unknown_path' THEN 404
            WHEN 'unsupported_media_type' THEN 415 WHEN 'body_too_large' THEN 413 WHEN 'too_many_lines' THEN 413
            ELSE CASE WHEN reason IS NULL THEN 200 ELSE 400 END END AS http_code,
       CASE WHEN is_post AND reason IS NULL
                 AND (nth > 1 OR idempotency_key IN (SELECT idempotency_key FROM known_keys)) THEN 'duplicate'
            ELSE reason END AS reason
FROM ranked"""

ORACLES: dict[str, str] = {
    "read_batches": f"""WITH {_BATCHES} SELECT idempotency_key, 'application/x-ndjson' AS content_type, received_at,
        strlen(body) AS n_bytes, body FROM judged""",
    "split_lines": f"""WITH {_BATCHES}, cut AS (SELECT user_id, block, copy, string_split(body, chr(10)) AS l FROM judged),
        numbered AS (SELECT user_id, block, copy, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM cut)
        SELECT user_id, block, copy, CAST(line_no AS INTEGER) AS line_no, line FROM numbered""",
    "scan_events": f"WITH {_STORED} SELECT {_EVENT_COLUMNS}, part FROM stored",
    "scan_partition": f"WITH {_STORED} SELECT {_EVENT_COLUMNS} FROM stored WHERE day < DATE '2024-01-10'",
    "install_listing": f"""WITH {_STORED} SELECT {_EVENT_COLUMNS} FROM stored WHERE install_id =
        (SELECT install_id FROM stored GROUP BY 1 ORDER BY count(*) DESC, install_id LIMIT 1)""",
    "write_events": f"""WITH {_BATCHES} SELECT CASE WHEN reason IS NULL THEN 'duplicate' ELSE 'rejected' END AS outcome,
        count(*) AS batches, CAST(0 AS BIGINT) AS new_rows FROM judged GROUP BY 1""",
    "write_ledger": f"WITH {_BATCHES} SELECT idempotency_key, install_id, line_count, received_at FROM ledger",
    "read_views": f"""WITH {_STORED}, d AS ({_DAILY}), f AS ({_FAMILY_DAILY})
        SELECT f.day, f.family, f.n, d.events, d.distinct_installs FROM f JOIN d ON f.day = d.day""",
    "read_views_pruned": f"""WITH {_STORED} SELECT * FROM ({_PROVIDER_DAILY})
        WHERE day BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-25'""",
    "read_views_percentiles": f"WITH {_STORED} {_DAILY}",
    "quarantine_sink": f"""WITH {_BATCHES} SELECT idempotency_key, received_at, 'rejected' AS status, 400 AS http_code,
        reason, bad_line AS line_no FROM judged WHERE reason IS NOT NULL""",
    "check_media_type": f"WITH {_REQUESTS} SELECT req_id, media_ok AS ok FROM posts",
    "check_idempotency_key": f"WITH {_REQUESTS} SELECT req_id, key_ok AS ok FROM posts",
    "check_body_bytes": f"WITH {_REQUESTS} SELECT req_id, size_ok AS ok FROM posts",
    "check_blank_body": f"WITH {_REQUESTS} SELECT req_id, filled AS ok FROM posts",
    "check_batch_lines": f"WITH {_REQUESTS} SELECT req_id, lines_sent BETWEEN 1 AND 25 AS ok FROM posts",
    "parse_events": f"WITH {_RUNS} SELECT user_id, day, {_KIND} AS kind, {_FAULTS} AS fault FROM runs",
    "check_schema_version": _line_check("1, 2, 3, 4"),
    "check_required_fields": _line_check("1, 5"),
    "check_unknown_fields_v1": _line_check("6, 7"),
    "lenient_v2plus": f"""WITH {_RUNS} SELECT {_KIND} AS kind, count(*) AS lines,
        count(*) FILTER ({_FAULTS} IS NULL) AS accepted FROM runs GROUP BY 1""",
    "check_types": _line_check(f"5, 9, 10, 16, 17, 18, 19, 22, {_REPEATED}"),
    "check_guid": _line_check("11"),
    "check_timestamp": _line_check("12, 25, 36, 37"),
    "check_future": f"""WITH {_BATCHES} SELECT user_id, block, copy,
        coalesce(reason = 'future_timestamp', FALSE) AS too_new FROM judged""",
    "batch_verdict": f"""WITH {_BATCHES} SELECT user_id, block, copy,
        CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
        CASE WHEN reason IS NULL THEN 200 ELSE 400 END AS http_code, reason, bad_line AS line_no FROM judged""",
    "flatten_event": f"""WITH {_RUNS} SELECT user_id, day, install_id, event_timestamp,
        CASE WHEN {_KIND} IN (8, 38) THEN 2 ELSE 1 END AS schema_version, tool_version, engine_version, dotnet_version,
        run_count, scenario_count,
        CASE WHEN {_KIND} = 24 THEN 0 ELSE step_pass END AS step_pass,
        CASE WHEN {_KIND} = 24 THEN 4 ELSE step_fail END AS step_fail,
        CASE WHEN {_KIND} = 24 THEN 0 ELSE step_env_error END AS step_env_error,
        CASE WHEN {_KIND} = 24 THEN 0 ELSE step_inconclusive END AS step_inconclusive,
        scenario_pass, scenario_fail, scenario_env_error, scenario_inconclusive, startup_ms, time_to_first_test_ms,
        CASE WHEN {_KIND} = 20 AND NOT contains(step_families, '"view"')
             THEN '{{"view":7,' || substr(step_families, 2) ELSE step_families END AS step_families,
        step_providers FROM runs WHERE {_FAULTS} IS NULL""",
    "default_verdicts": f"""WITH {_RUNS} SELECT user_id, day, CAST(NULL AS VARCHAR) AS fault, scenario_pass,
        0 AS scenario_fail, 0 AS scenario_env_error, 0 AS scenario_inconclusive FROM runs""",
    "to_utc": f"WITH {_RUNS} SELECT user_id, day, event_timestamp FROM runs",
    "encode_event": f"WITH {_RUNS} SELECT user_id, day, {_json_line('ts')} AS line FROM runs",
    "batch_key": f"WITH {_BATCHES} SELECT user_id, block, copy, idempotency_key AS key FROM judged",
    "audit_batch_key": f"""WITH {_REQUESTS} SELECT key_ok AND filled AND size_ok AS key_matches, count(*) AS batches
        FROM posts GROUP BY 1""",
    "redact_install_id": f"""WITH {_RUNS} SELECT DISTINCT user_id,
        lpad(CAST(user_id AS VARCHAR), 8, '9') || '…' AS shown FROM runs""",
    "parse_forget": f"WITH {_REQUESTS} SELECT req_id, CASE WHEN size_ok THEN install_id END AS install_id FROM forgets",
    "audit_taxonomy": f"""WITH {_STORED} SELECT family, count(*) AS runs, CAST(sum(n) AS BIGINT) AS n
        FROM stored JOIN fam USING (user_id, day) GROUP BY 1""",
    "dedup_batches": f"""WITH {_BATCHES}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at) AS nth FROM judged)
        SELECT user_id, block, copy, idempotency_key FROM ranked WHERE nth = 1 AND idempotency_key NOT IN
          (SELECT idempotency_key FROM ledger WHERE received_at < TIMESTAMP '2024-01-15')""",
    "dedup_events": f"""WITH {_BATCHES}, offered AS (
          SELECT r.install_id, r.ts AS event_timestamp, r.schema_version, r.day, j.block, j.copy,
                 row_number() OVER (PARTITION BY r.user_id, r.day ORDER BY j.received_at, j.idempotency_key) AS nth
          FROM judged j JOIN runs r ON r.user_id = j.user_id AND (j.block = -1 OR j.block = r.block)
          WHERE j.reason IS NULL)
        SELECT install_id, event_timestamp, schema_version, block, copy FROM offered
        WHERE nth = 1 AND (install_id, day) NOT IN (
          SELECT r.install_id, r.day FROM firsts f JOIN runs r ON r.user_id = f.user_id AND (f.block = -1 OR f.block = r.block)
          WHERE f.received_at < TIMESTAMP '2024-01-15')""",
    "forget_events": f"WITH {_STORED} SELECT install_id, count(*) AS rows FROM stored WHERE NOT {_ERASED} GROUP BY 1",
    "forget_ledger": f"WITH {_BATCHES} SELECT install_id, count(*) AS batches FROM ledger WHERE NOT {_ERASED} GROUP BY 1",
    "forget_before_compaction": f"""WITH {_STORED} SELECT install_id, count(*) AS held,
        count(*) FILTER (NOT {_ERASED}) AS rows FROM stored GROUP BY 1""",
    "forget_after_compaction": f"""WITH {_BATCHES}, {_STORED_RUNS}, early AS (SELECT * FROM firsts WHERE received_at < TIMESTAMP '2024-01-15'),
        events AS (
          SELECT install_id FROM stored WHERE NOT {_ERASED}
          UNION ALL SELECT install_id FROM runs r WHERE {_ERASED} AND EXISTS (
            SELECT 1 FROM early e WHERE e.user_id = r.user_id AND (e.block = -1 OR e.block = r.block))),
        batches_held AS (SELECT install_id FROM ledger WHERE NOT {_ERASED} OR received_at < TIMESTAMP '2024-01-15')
        SELECT install_id, 'events' AS held, count(*) AS rows FROM events GROUP BY 1
        UNION ALL SELECT install_id, 'batches' AS held, count(*) AS rows FROM batches_held GROUP BY 1""",
    "forget_upsert": f"WITH {_FORGET_STATE} SELECT install_id, requested_at, processed_at FROM queue",
    "forget_status": f"""WITH {_FORGET_STATE} SELECT install_id, requested_at, processed_at,
        CASE WHEN processed_at IS NULL THEN 'pending' ELSE 'processed' END AS state FROM queue""",
    "pending_forgets": f"WITH {_FORGET_STATE} SELECT install_id, CASE WHEN processed_at IS NULL THEN requested_at "
    f"ELSE {_REQUESTED_AT.replace('user_id', 'CAST(right(install_id, 12) AS BIGINT)')} END AS requested_at FROM queue",
    "unnest_families": f"""WITH {_STORED} SELECT install_id, event_timestamp, family, CAST(n AS INTEGER) AS n
        FROM stored JOIN fam USING (user_id, day)""",
    "unnest_providers": f"""WITH {_STORED} SELECT install_id, event_timestamp, provider, CAST(n AS INTEGER) AS n
        FROM stored JOIN prov USING (user_id, day)""",
    "route_partition": f"""WITH {_RUNS} SELECT user_id, day,
        CASE WHEN day >= DATE '2024-01-10' THEN strftime(day, '%Y%m%d') ELSE 'default' END AS part FROM runs""",
    "v_run_daily": f"WITH {_STORED} {_DAILY}",
    "v_step_family_daily": f"WITH {_STORED} {_FAMILY_DAILY}",
    "v_step_provider_daily": f"WITH {_STORED} {_PROVIDER_DAILY}",
    "pctl_timing": f"""WITH {_STORED} SELECT install_id,
        round(quantile_cont(startup_ms, 0.5), 6) AS startup_ms_p50,
        round(quantile_cont(startup_ms, 0.95), 6) AS startup_ms_p95,
        round(quantile_cont(time_to_first_test_ms, 0.5), 6) AS time_to_first_test_ms_p50,
        round(quantile_cont(time_to_first_test_ms, 0.95), 6) AS time_to_first_test_ms_p95
        FROM stored GROUP BY 1""",
    "distinct_installs": f"""WITH {_STORED} SELECT date_trunc('day', event_timestamp) AS day,
        count(DISTINCT install_id) AS distinct_installs FROM stored GROUP BY 1""",
    "distinct_installs_by_period": f"""WITH {_STORED}, left_over AS (SELECT * FROM stored WHERE NOT {_ERASED})
        SELECT 'week' AS period, CAST(date_trunc('week', event_timestamp) AS TIMESTAMP) AS start,
          count(DISTINCT install_id) AS distinct_installs, TRUE AS near FROM left_over GROUP BY 2
        UNION ALL SELECT 'month', CAST(date_trunc('month', event_timestamp) AS TIMESTAMP),
          count(DISTINCT install_id), TRUE FROM left_over GROUP BY 2""",
    "batch_summary": f"""WITH {_BATCHES} SELECT idempotency_key, '00000000-0000-4000-8000-' || padded AS install_id,
        CAST(n_lines AS INTEGER) AS line_count, received_at FROM judged WHERE reason IS NULL""",
    "ingest_result": f"""WITH {_BATCHES}, added AS (
          SELECT user_id, block, copy, count(*) AS new_rows FROM carried WHERE nth = 1 GROUP BY 1, 2, 3)
        SELECT j.idempotency_key, j.received_at, CASE WHEN j.reason IS NULL THEN 200 ELSE 400 END AS http_code,
               CASE WHEN j.reason IS NOT NULL THEN 'rejected' WHEN f.user_id IS NOT NULL THEN 'accepted'
                    ELSE 'duplicate' END AS outcome,
               j.reason, j.bad_line, CASE WHEN j.reason IS NULL THEN CAST(j.n_lines AS INTEGER) END AS total_events,
               coalesce(a.new_rows, 0) AS new_rows
        FROM judged j LEFT JOIN firsts f USING (user_id, block, copy) LEFT JOIN added a USING (user_id, block, copy)""",
    "partition_inventory": f"""WITH {_STORED}, named AS (
          SELECT 'default' AS part UNION ALL SELECT strftime(d, '%Y%m%d') FROM (
            SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-02-02', INTERVAL 1 DAY)) AS d))
        SELECT n.part, count(s.part) AS rows FROM named n LEFT JOIN stored s USING (part) GROUP BY 1""",
    "default_backlog": f"WITH {_STORED} SELECT count(*) AS rows FROM stored WHERE part = 'default'",
    "events_by_install": f"WITH {_STORED} SELECT install_id, count(*) AS rows FROM stored GROUP BY 1",
    "ingest_rate_hourly": f"""WITH {_BATCHES}, added AS (
          SELECT user_id, block, copy, count(*) AS new_rows FROM carried WHERE nth = 1 GROUP BY 1, 2, 3)
        SELECT date_trunc('hour', received_at) AS hour, count(*) AS batches,
               CAST(sum(coalesce(new_rows, 0)) AS BIGINT) AS new_rows
        FROM judged LEFT JOIN added USING (user_id, block, copy) WHERE reason IS NULL GROUP BY 1""",
    "error_rate_hourly": f"""WITH {_BATCHES} SELECT date_trunc('hour', received_at) AS hour, 400 AS http_code, reason,
        count(*) AS batches FROM judged WHERE reason IS NOT NULL GROUP BY ALL""",
    "maintenance_status": f"""WITH {_BATCHES}, counts(step, rows) AS (
          SELECT 'ensure_partitions', 7 UNION ALL SELECT 'drop_old_partitions', 6
          UNION ALL SELECT 'sweep_default', (SELECT count(*) FROM runs WHERE NOT {_LOST} AND day < DATE '2024-01-10')
          UNION ALL SELECT 'forget_drain', (SELECT count(DISTINCT user_id) FROM runs WHERE {_ERASED})
          UNION ALL SELECT 'compact', (SELECT count(*) FROM runs WHERE NOT {_LOST} AND {_ERASED} AND day >= DATE '2024-01-16')
                                      + (SELECT count(*) FROM ledger WHERE {_ERASED})
          UNION ALL SELECT 'purge_ledger', (SELECT count(*) FROM ledger WHERE NOT {_ERASED})
          UNION ALL SELECT 'trim_logs', 0)
        SELECT step, TIMESTAMP '2024-04-15' AS as_of, TRUE AS ok, CAST(rows AS BIGINT) AS rows,
               CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS failures FROM counts""",
    "provider_ranking": f"""WITH {_STORED} SELECT provider, CAST(sum(n) AS BIGINT) AS n, count(*) AS runs
        FROM stored JOIN prov USING (user_id, day) GROUP BY 1 ORDER BY n DESC, provider LIMIT 10""",
    "family_ranking": f"""WITH {_STORED} SELECT family, CAST(sum(n) AS BIGINT) AS n, count(*) AS runs
        FROM stored JOIN fam USING (user_id, day) GROUP BY 1""",
    "env_error_by_provider": f"""WITH {_STORED} SELECT provider, count(*) AS runs,
        count(*) FILTER (step_env_error > 0) AS runs_with_env_error, CAST(sum(step_env_error) AS BIGINT) AS env_errors
        FROM stored JOIN prov USING (user_id, day) GROUP BY 1""",
    "version_matrix": f"""WITH {_STORED} SELECT tool_version, engine_version, dotnet_version,
        CAST(sum(run_count) AS BIGINT) AS runs, count(DISTINCT install_id) AS installs FROM stored GROUP BY ALL""",
    "timing_trend": f"""WITH {_STORED}, d AS (
          SELECT date_trunc('day', event_timestamp) AS day, quantile_cont(startup_ms, 0.5) AS s,
                 quantile_cont(time_to_first_test_ms, 0.5) AS t FROM stored GROUP BY 1)
        SELECT day, round(s, 6) AS startup_ms_p50, round(t, 6) AS time_to_first_test_ms_p50,
               round(s - lag(s) OVER (ORDER BY day), 6) AS startup_ms_p50_change,
               round(t - lag(t) OVER (ORDER BY day), 6) AS time_to_first_test_ms_p50_change FROM d""",
    "list_partitions": f"""WITH {_STORED} SELECT 'default' AS part
        UNION ALL SELECT strftime(d, '%Y%m%d') FROM (
          SELECT unnest(generate_series(DATE '2024-01-21', DATE '2024-01-31', INTERVAL 1 DAY)) AS d)""",
    "stream_ingest": f"WITH {_STORED} SELECT {_EVENT_COLUMNS}, part FROM stored",
    "stream_rollup": f"WITH {_STORED} {_DAILY}",
    "stream_dedup_window": f"""WITH {_BATCHES}, visits AS (
          SELECT DISTINCT idempotency_key, 0 AS later FROM judged
          UNION ALL SELECT DISTINCT idempotency_key, 1 FROM judged
          UNION ALL SELECT DISTINCT sha256(idempotency_key || 'fresh'), 1 FROM judged WHERE user_id % 3 = 0)
        SELECT idempotency_key, count(*) AS passed, CAST(sum(later) AS BIGINT) AS later FROM visits GROUP BY 1""",
    "retry_semantics": f"""WITH {_BATCHES} SELECT 'telemetry_event' AS "table", count(*) AS rows FROM runs WHERE NOT {_LOST}
        UNION ALL SELECT 'ingest_batch', count(*) FROM ledger""",
    "ensure_partitions": f"""WITH {_STORED}, days AS (
          SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-02-09', INTERVAL 1 DAY)) AS DATE) AS day)
        SELECT day, CASE WHEN day BETWEEN DATE '2024-01-10' AND DATE '2024-01-31' THEN 'exists'
                         WHEN day IN (SELECT day FROM stored) THEN 'conflict' ELSE 'created' END AS state FROM days""",
    "drop_old_partitions": f"WITH {_STORED} {_PARTS} WHERE day < DATE '2024-01-10' OR day >= DATE '2024-01-21' GROUP BY 1",
    "sweep_default": f"""WITH {_STORED} {_PARTS}
        WHERE day >= DATE '2024-01-10' OR event_timestamp >= TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1""",
    "forget_drain": f"WITH {_STORED} {_PARTS} WHERE NOT {_ERASED} GROUP BY 1",
    "compact_days": f"WITH {_STORED} SELECT *, 0 AS scattered FROM ({_PARTS} GROUP BY 1)",
    "forget_after_reshard": f"WITH {_STORED} SELECT install_id, count(*) AS rows FROM stored WHERE user_id % 50 <> 7 GROUP BY 1",
    "dedup_after_reshard": f"WITH {_STORED} SELECT install_id, count(*) AS rows FROM stored GROUP BY 1",
    "stream_rollup_after_forget": f"WITH {_STORED} {_DAILY.replace('FROM stored', f'FROM stored WHERE NOT {_ERASED}')}",
    "stream_rollup_after_drop": f"""WITH {_STORED}
        {_DAILY.replace('FROM stored', "FROM stored WHERE day < DATE '2024-01-10' OR day >= DATE '2024-01-21'")}""",
    "stream_rollup_after_crash": f"WITH {_STORED} {_DAILY}",
    "late_data": f"""WITH {_STORED} SELECT date_trunc('day', event_timestamp) AS day, count(*) AS rows FROM stored
        WHERE day < DATE '2024-01-10' GROUP BY 1""",
    "bootstrap_tables": f"""WITH {_BATCHES} SELECT 'telemetry_event' AS "table", count(*) AS rows FROM runs WHERE NOT {_LOST}
        UNION ALL SELECT 'ingest_batch', count(*) FROM ledger
        UNION ALL SELECT 'partition_log', 97 UNION ALL SELECT 'default', 0
        UNION ALL SELECT 'v_run_daily', count(DISTINCT day) FROM runs WHERE NOT {_LOST}""",
    "purge_ledger": f"""WITH {_BATCHES} SELECT strftime(received_at, '%Y%m%d') AS received_day, count(*) AS batches
        FROM ledger WHERE received_at >= TIMESTAMP '2024-01-22 00:00:30' GROUP BY 1""",
    "maintenance_cycle": f"WITH {_STORED} {_PARTS} WHERE NOT {_ERASED} AND day >= DATE '2024-01-16' GROUP BY 1",
    "match_tokens": f"WITH {_REQUESTS} SELECT req_id, known AS authenticated FROM keyed",
    "rate_partition_key": f"WITH {_REQUESTS} SELECT rate_key, count(*) AS requests FROM keyed GROUP BY 1",
    "fixed_window_admission": f"WITH {_REQUESTS} SELECT req_id, admitted FROM admission",
    "request_outcome": f"WITH {_REQUESTS}, {_OUTCOME}",
}
