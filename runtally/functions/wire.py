"""The wire contract of one event line, as SQL expressions.

A line goes through a chain of array transforms, each built on the one before:
``parse_line`` -> ``extract`` -> ``convert`` -> ``line_fault`` / ``flatten_event``. The
text is tokenised once for its values and once for its property names, and because
nothing inside a lambda is shared, every costly value gets a stage of its own.

The pieces are SQL text over a lambda variable: the whole check is some four hundred
function calls, which Spark parses in milliseconds, while building as many Column
objects from Python takes seconds per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runtally.functions.text import GUID
from runtally.schema import VERDICT_FIELDS, WIRE_FIELDS

# Free-text fields are read as VARIANT: a plain string field would quietly accept numbers.
_TEXT_FIELDS = ["timestamp", "installId", "toolVersion", "engineVersion", "dotnetVersion"]
_VERDICTS = ["stepVerdicts", "scenarioVerdicts"]
_MAPS = ["stepFamilies", "stepProviders"]
_NUMBERS = {"runCount": "int", "scenarioCount": "int", "startupMs": "bigint", "timeToFirstTestMs": "bigint"}

_TYPES = (
    {"schemaVersion": "variant"}
    | {name: "variant" for name in _TEXT_FIELDS}
    | {name: "map<string,variant>" for name in _VERDICTS}
    | {name: "map<string,int>" for name in _MAPS}
    | _NUMBERS
)
_DOCUMENTS = "array<struct<" + ",".join(f"{name}:{_TYPES[name]}" for name in WIRE_FIELDS) + ">>"
STRICT_JSON = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"

# ISO 8601 with a 'T'; date alone or minutes precision allowed, offset up to 14:00.
_ISO = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}"
    r"(T\d{2}:\d{2}(:\d{2}(\.\d{1,16})?)?(Z|[+-](0\d|1[0-3])(:[0-5]\d)?|[+-]14(:00)?)?)?\z"
)

# Fixed value: objects and arrays that may be open at once, the event's own included.
MAX_DEPTH = 64


def _names(names: list[str]) -> str:
    return "array(" + ", ".join(f"'{name}'" for name in names) + ")"


_DECLARED = _names(WIRE_FIELDS)
_DECLARED_VERDICTS = _names(VERDICT_FIELDS)


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _as_int(value: str) -> str:
    """Int32 of a VARIANT that holds an integral JSON number; null otherwise."""
    return f"if(schema_of_variant({value}) = 'BIGINT', try_variant_get({value}, '$', 'int'), null)"


def _as_text(value: str) -> str:
    return f"if(schema_of_variant({value}) = 'STRING', try_variant_get({value}, '$', 'string'), null)"


def _last_wins(entries: str) -> str:
    """Map with each repeated key reduced to its last value."""
    keys = f"map_keys({entries})"
    return (
        f"if(size(array_distinct({keys})) < size({keys}), map_from_entries(filter(map_entries({entries}), "
        f"(e, i) -> not array_contains(slice({keys}, i + 2, size({keys})), e.key))), {entries})"
    )


def _too_deep(line: str) -> str:
    """Whether more than MAX_DEPTH brackets are open at once outside of strings; walked
    only for a line that has so many brackets at all."""
    bare = rf"""regexp_replace({line}, r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"', '')"""
    steps = f"split(regexp_replace({bare}, r'[^\\[\\]{{}}]', ''), '')"
    depth = (
        f"aggregate({steps}, named_struct('now', 0, 'most', 0), (a, c) -> named_struct("
        "'now', a.now + if(c in ('[', '{'), 1, if(c = '', 0, -1)), "
        "'most', greatest(a.most, a.now + if(c in ('[', '{'), 1, 0))), a -> a.most)"
    )
    many = rf"{line} rlike r'^(?:[^\[{{]*+[\[{{]){{{MAX_DEPTH + 1}}}'"
    return f"if({many}, {depth} > {MAX_DEPTH}, false)"


def _each_value(entries: str, sound: str) -> str:
    return f"forall({entries}, m -> {sound})"


def _members(value: str) -> str:
    """Entries of an object held as VARIANT."""
    return f"map_entries(try_variant_get({value}, '$', 'map<string,variant>'))"


def _sound_repeat(e: str) -> str:
    """Whether one occurrence of a property has the property's type."""
    value = f"{e}.value"
    an_object = f"startswith(schema_of_variant({value}), 'OBJECT')"
    counted = f"(m.key not in ({', '.join(repr(f) for f in VERDICT_FIELDS)}) or {_as_int('m.value')} is not null)"
    whole = {name: _as_int(value) for name in ["schemaVersion", *[n for n, t in _NUMBERS.items() if t == "int"]]}
    whole |= {
        name: f"if(schema_of_variant({value}) = 'BIGINT', try_variant_get({value}, '$', 'bigint'), null)"
        for name, kind in _NUMBERS.items()
        if kind == "bigint"
    }
    rules = {name: f"{_as_text(value)} is not null" for name in _TEXT_FIELDS}
    rules |= {name: f"{number} is not null" for name, number in whole.items()}
    rules |= {name: f"{an_object} and {_each_value(_members(value), counted)}" for name in _VERDICTS}
    rules |= {name: f"{an_object} and {_each_value(_members(value), _as_int('m.value') + ' is not null')}" for name in _MAPS}
    cases = " ".join(f"when {e}.key = '{name}' then {rule}" for name, rule in rules.items())
    return f"coalesce(case {cases} else true end, false)"


def _known_repeat(e: str) -> str:
    names = ", ".join(repr(name) for name in _VERDICTS)
    known = _each_value(_members(f"{e}.value"), f"m.key in ({', '.join(repr(f) for f in VERDICT_FIELDS)})")
    return f"({e}.key not in ({names}) or coalesce({known}, true))"


def parse_line(line: str) -> str:
    """Struct(keys, tag, docs, repeats, deep).

    ``repeats``: every property occurrence of a line that repeats one, else null. The typed
    read keeps the last value that fits; whether each occurrence fits is seen here alone.

    ``from_json`` ignores whatever follows the first complete value. The line is
    therefore put in an array in front of a marker derived from the line itself: only
    a line that is exactly one JSON value leaves the marker as second element.
    """
    tag = f"cast(xxhash64({line}) as string)"
    boxed = f"""concat('[', {line}, ',{{"toolVersion":"', {tag}, '"}}]')"""
    keys = f"json_object_keys({line})"
    occurrences = f"coalesce(map_entries(from_json({line}, 'map<string,variant>', {STRICT_JSON})), array())"
    return _struct(
        keys=keys,
        tag=tag,
        docs=f"from_json({boxed}, '{_DOCUMENTS}', {STRICT_JSON})",
        repeats=f"if({keys} = {_DECLARED} or size(array_distinct({keys})) = size({keys}), null, {occurrences})",
        deep=_too_deep(line),
    )


def extract(p: str) -> str:
    """Struct of the plain values of the line; null where the JSON type is wrong."""
    doc, marker = f"get({p}.docs, 0)", f"get({p}.docs, 1).toolVersion"
    fields = {
        "well_formed": f"coalesce(size({p}.docs) = 2 and {doc} is not null and {_as_text(marker)} = {p}.tag "
        f"and {p}.keys is not null and not {p}.deep, false)",
        "keys": f"{p}.keys",
        "repeats_typed": f"({p}.repeats is null or (size({p}.repeats) = size({p}.keys) and "
        f"forall({p}.repeats, e -> {_sound_repeat('e')})))",
        "repeats_known": f"({p}.repeats is null or forall({p}.repeats, e -> {_known_repeat('e')}))",
        "schemaVersion": _as_int(f"{doc}.schemaVersion"),
    }
    for name in _TEXT_FIELDS:
        fields[name] = _as_text(f"{doc}.{name}")
    nulls = " or ".join(f"coalesce(is_variant_null({doc}.{name}), false)" for name in _TEXT_FIELDS)
    fields["null_text"] = nulls
    for name in _VERDICTS + _MAPS:
        fields[name] = _last_wins(f"{doc}.{name}")
    for name in _NUMBERS:
        fields[name] = f"{doc}.{name}"
    return _struct(**fields)


def convert(v: str) -> str:
    """The same struct with the timestamp as an instant and the verdicts as counts."""
    kept = ["well_formed", "keys", "repeats_typed", "repeats_known", "schemaVersion", *_TEXT_FIELDS, "null_text", *_MAPS, *_NUMBERS]
    fields = {name: f"{v}.{name}" for name in kept}
    fields["instant"] = utc_instant(f"{v}.timestamp")
    for name in _VERDICTS:
        counts = _struct(**{m: _as_int(f"try_element_at({v}.{name}, '{m}')") for m in VERDICT_FIELDS})
        fields[name] = f"if({v}.{name} is not null, {counts}, null)"
        fields[f"{name}_keys"] = f"map_keys({v}.{name})"
    return _struct(**fields)


def has_schema_version(n: str) -> str:
    return f"coalesce(array_contains({n}.keys, 'schemaVersion'), false)"


def has_integer_version(n: str) -> str:
    return f"{n}.schemaVersion is not null"


def has_supported_version(n: str) -> str:
    return f"coalesce({n}.schemaVersion >= 1, false)"


def has_required_fields(n: str) -> str:
    """A client that keeps the frozen order needs no set comparison."""
    return f"coalesce({n}.keys = {_DECLARED} or size(array_except({_DECLARED}, {n}.keys)) = 0, false)"


def has_only_known_fields(n: str) -> str:
    """Version 1 admits no undeclared property, nor one inside a verdict object."""
    known = [f"({n}.keys = {_DECLARED} or size(array_except({n}.keys, {_DECLARED})) = 0)", f"{n}.repeats_known"]
    for name in _VERDICTS:
        keys = f"{n}.{name}_keys"
        known.append(
            f"coalesce({keys} = {_DECLARED_VERDICTS} or size(array_except({keys}, {_DECLARED_VERDICTS})) = 0, true)"
        )
    return f"(coalesce({n}.schemaVersion > 1, false) or coalesce({' and '.join(known)}, false))"


def has_no_null_text(n: str) -> str:
    return f"not {n}.null_text"


def has_right_types(n: str) -> str:
    """All values present in their type, also each value of a repeated property; an absent
    verdict member is fine, a wrong one is not."""
    ok = [f"{n}.{name} is not null" for name in [*_TEXT_FIELDS, *_NUMBERS, *_VERDICTS]]
    for name in _VERDICTS:
        for member in VERDICT_FIELDS:
            absent = f"not array_contains({n}.{name}_keys, '{member}')"
            ok.append(f"({n}.{name}.{member} is not null or {absent})")
    ok += [f"not exists(map_values({n}.{name}), x -> x is null)" for name in _MAPS]
    ok.append(f"{n}.repeats_typed")
    return f"coalesce({' and '.join(ok)}, false)"


def has_guid(n: str) -> str:
    return f"coalesce({n}.installId rlike r'{GUID}', false)"


def utc_instant(text: str) -> str:
    """UTC instant at microseconds; text without an offset counts as UTC."""
    zoned = f"(endswith({text}, 'Z') or substring({text}, -6, 1) in ('+', '-') or substring({text}, -3, 1) in ('+', '-'))"
    full = (
        f"case when not contains({text}, 'T') then concat({text}, 'T00:00:00Z') "
        f"when not {zoned} then concat({text}, 'Z') else {text} end"
    )
    # Spark wants seconds before an offset, and at most the microseconds kept anyway.
    seconds = f"if(substring({full}, 17, 1) = ':', {full}, concat(left({full}, 16), ':00', substring({full}, 17)))"
    micros = rf"if(length({text}) > 26, regexp_replace({full}, r'(\.\d{{6}})\d+', '$1'), {seconds})"
    return f"if({text} rlike r'{_ISO}', try_cast({micros} as timestamp), null)"


def has_timestamp(n: str) -> str:
    return f"{n}.instant is not null"


# In the order a line meets them; the first that fails names the fault.
CHECKS = [
    ("malformed_json", lambda n: f"{n}.well_formed"),
    ("missing_schema_version", has_schema_version),
    ("schema_version_not_integer", has_integer_version),
    ("schema_version_below_one", has_supported_version),
    ("missing_field", has_required_fields),
    ("unknown_field", has_only_known_fields),
    ("null_required", has_no_null_text),
    ("wrong_type", has_right_types),
    ("bad_install_id", has_guid),
    ("bad_timestamp", has_timestamp),
]


def line_fault(n: str) -> str:
    """Name of the first broken rule, or null for a good line."""
    return "case " + " ".join(f"when not ({check(n)}) then '{name}'" for name, check in CHECKS) + " end"


def flatten_event(n: str) -> str:
    """Flat event struct in table order; absent verdict members count as zero."""
    verdicts = {
        f"{prefix}_{column}": f"coalesce({n}.{source}.{member}, 0)"
        for prefix, source in [("step", "stepVerdicts"), ("scenario", "scenarioVerdicts")]
        for member, column in zip(VERDICT_FIELDS, ["pass", "fail", "env_error", "inconclusive"])
    }
    return _struct(
        install_id=f"lower({n}.installId)",
        event_timestamp=f"{n}.instant",
        schema_version=f"{n}.schemaVersion",
        tool_version=f"{n}.toolVersion",
        engine_version=f"{n}.engineVersion",
        dotnet_version=f"{n}.dotnetVersion",
        run_count=f"{n}.runCount",
        scenario_count=f"{n}.scenarioCount",
        **verdicts,
        step_families=f"{n}.stepFamilies",
        step_providers=f"{n}.stepProviders",
        startup_ms=f"{n}.startupMs",
        time_to_first_test_ms=f"{n}.timeToFirstTestMs",
    )


def normalized_lines(lines: str) -> Column:
    """Typed values of every line of an array column, given by name."""
    return F.expr(_normalized(lines))


def _normalized(lines: str) -> str:
    parsed = f"transform({lines}, l -> {parse_line('l')})"
    return f"transform(transform({parsed}, p -> {extract('p')}), v -> {convert('v')})"


# Parts a frozen line is taken apart into; the sign between them is in none of its parts.
_PARTS = [
    part for name in WIRE_FIELDS for part in ([f"{name}.{member}" for member in VERDICT_FIELDS] if name in _VERDICTS else [name])
]
_BETWEEN = "\x01"


def _frozen_line() -> str:
    """A pattern of lines that are sound but for the calendar and repeated uses, with a group per
    part: all properties once in frozen order, plain ASCII text without escapes, counts that fit
    their type, a timestamp with its offset."""
    text, use, count = r'"([ !#-\[\]-~]{0,200}+)"', r'"[ !#-+\--9;-\[\]-~]{0,200}+"', r"(?:0|[1-9]\d{0,8})"
    verdicts = r"\{" + ",".join(f'"{member}":({count})' for member in VERDICT_FIELDS) + r"\}"
    uses = rf"\{{((?:{use}:{count}(?:,{use}:{count})*+)?)\}}"
    offset = r"(?:Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)"
    values = {
        "schemaVersion": r"([1-9]\d{0,8})",
        "timestamp": rf'"((?!0000)\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d{{1,6}})?{offset})"',
        "installId": '"(' + GUID.removeprefix("^").removesuffix(r"\z") + ')"',
    }
    values |= {name: text for name in _TEXT_FIELDS if name not in values}
    values |= {name: f"({count})" if kind == "int" else r"(0|[1-9]\d{0,17})" for name, kind in _NUMBERS.items()}
    values |= {name: verdicts for name in _VERDICTS} | {name: uses for name in _MAPS}
    return r"^\{" + ",".join(f'"{name}":{values[name]}' for name in WIRE_FIELDS) + r"\}\z"


def _taken_apart(line: str) -> str:
    """The parts of a frozen line; another number of parts, or null, for any other line."""
    parts = _BETWEEN.join(f"${k}" for k in range(1, len(_PARTS) + 1))
    return f"if(contains({line}, '{_BETWEEN}'), null, split(regexp_replace({line}, r'{_frozen_line()}', '{parts}'), '{_BETWEEN}'))"


def _read_parts(p: str) -> str:
    """Typed values of a frozen line's parts; null for any other line."""
    at = {part: f"get({p}, {k})" for k, part in enumerate(_PARTS)}
    fields = {"schemaVersion": f"cast({at['schemaVersion']} as int)"} | {name: at[name] for name in _TEXT_FIELDS}
    fields |= {name: f"cast({at[name]} as {kind})" for name, kind in _NUMBERS.items()}
    for name in _VERDICTS:
        fields[name] = _struct(**{member: f"cast({at[f'{name}.{member}']} as int)" for member in VERDICT_FIELDS})
    for name in _MAPS:
        keys = rf"""split(regexp_replace({at[name]}, r'"(?::\d+)?', ''), ',')"""
        counts = f"""cast(split(regexp_replace({at[name]}, r'"[^"]*+":', ''), ',') as array<int>)"""
        fields[f"{name}_keys"] = f"if({at[name]} = '', cast(array() as array<string>), {keys})"
        fields[f"{name}_counts"] = f"if({at[name]} = '', cast(array() as array<int>), {counts})"
    fields["instant"] = f"try_cast({at['timestamp']} as timestamp)"
    return f"if(size({p}) = {len(_PARTS)}, {_struct(**fields)}, null)"


def _checked_parts(d: str) -> str:
    """Fault and event of a frozen line from its typed values."""
    fields = {name: f"{d}.{name}" for name in ["schemaVersion", *_TEXT_FIELDS, *_NUMBERS, *_VERDICTS, "instant"]}
    fields |= {name: f"map_from_arrays({d}.{name}_keys, {d}.{name}_counts)" for name in _MAPS}
    checked = _struct(fault=f"if({has_timestamp('n')}, null, 'bad_timestamp')", event=flatten_event("n"))
    return f"get(transform(array({_struct(**fields)}), n -> {checked}), 0)"


def _checked_by_chain(lines: str) -> str:
    checked = _struct(fault=line_fault("n"), event=flatten_event("n"))
    return f"transform({_normalized(lines)}, n -> {checked})"


def checked_lines(lines: str) -> Column:
    """array<struct<fault, event>> for an array column of lines, given by name.

    Lines as clients write them are taken apart by one pattern, which costs a fraction of the
    chain; each other line, and one that repeats a use, goes through the chain. Both give the same.
    """
    apart = f"transform({lines}, l -> {_struct(l='l', p=_taken_apart('l'))})"
    read = f"transform({apart}, a -> {_struct(l='a.l', d=_read_parts('a.p'))})"
    single = " and ".join(f"size(array_distinct(r.d.{name}_keys)) = size(r.d.{name}_keys)" for name in _MAPS)
    chain = f"get({_checked_by_chain('array(r.l)')}, 0)"
    return F.expr(f"transform({read}, r -> if(r.d is not null and {single}, {_checked_parts('r.d')}, {chain}))")


def wire_timestamp(instant: Column) -> Column:
    """ISO text of a UTC instant; the fraction is written only when there is one."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(instant, "SSSSSS")
    shown = F.when(fraction == "000000", F.lit("")).otherwise(
        F.concat(F.lit("."), F.regexp_replace(fraction, "0+$", ""))
    )
    return F.concat(whole, shown, F.lit("+00:00"))


def encode_event() -> Column:
    """Wire JSON of a row with the flat event columns, properties in frozen order."""

    def verdicts(prefix: str) -> Column:
        return F.struct(
            F.col(f"{prefix}_pass").alias("pass"),
            F.col(f"{prefix}_fail").alias("fail"),
            F.col(f"{prefix}_env_error").alias("envError"),
            F.col(f"{prefix}_inconclusive").alias("inconclusive"),
        )

    values = [
        F.col("schema_version"),
        wire_timestamp(F.col("event_timestamp")),
        F.col("install_id"),
        F.col("tool_version"),
        F.col("engine_version"),
        F.col("dotnet_version"),
        F.col("run_count"),
        F.col("scenario_count"),
        verdicts("step"),
        verdicts("scenario"),
        F.col("step_families"),
        F.col("step_providers"),
        F.col("startup_ms"),
        F.col("time_to_first_test_ms"),
    ]
    return F.to_json(F.struct(*[v.alias(name) for v, name in zip(values, WIRE_FIELDS)]))
