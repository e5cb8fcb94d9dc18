"""Numeric building blocks of the scoring rules and date-header handling, as SQL expression text."""

from __future__ import annotations

from wonted.config import DEFAULT_REGISTRY, Registry
from wonted.functions.sql import literal


def fired(raw: str) -> str:
    """Raw value clamped to 0..1 and rounded to four digits; NULL when it does not fire."""
    return f"CASE WHEN ({raw}) > 0 THEN round(least({raw}, 1D), 4) END"


def confidence(n: str, registry: Registry = DEFAULT_REGISTRY) -> str:
    """How much a baseline of n messages is worth."""
    return f"({n} / ({n} + {registry.confidence_k}))"


def ramp(z: str, bounds: tuple) -> str:
    start, full = bounds
    return f"(({z} - {start}D) / {full - start}D)"


# Moments are kept as (n, total, squares) of values counted in whole units of 10^-digits: integers in
# decimals, so that partial sums merge exactly, in any order and under any split, and nothing cancels.


def units(value: str, digits: int) -> str:
    """A real value as a whole number of units, for ``total``."""
    return f"cast(cast(round({value} * 1e{digits}D) AS bigint) AS decimal(19,0))"


def squared(value: str) -> str:
    """The square of a whole number, for ``squares``."""
    return f"cast({value} AS decimal(19,0)) * cast({value} AS decimal(19,0))"


def mean_of(total: str, n: str, digits: int = 0) -> str:
    return f"(cast({total} AS double) / nullif({n}, 0) / 1e{digits}D)"


def m2_of(total: str, squares: str, n: str, digits: int = 0) -> str:
    """Sum of squared distances from the mean.  Distances are taken from the whole number next to the mean, exactly;
    what is left of the mean is less than a unit."""
    whole = "decimal(19,0)"
    middle = f"cast({total} div nullif({n}, 0) AS {whole})"
    around = f"{squares} - 2BD * {middle} * {total} + cast({n} AS {whole}) * {middle} * {middle}"
    rest = f"cast({total} - cast({n} AS {whole}) * {middle} AS double)"
    return f"(greatest(cast({around} AS double) - {rest} * {rest} / nullif({n}, 0), 0D) / 1e{2 * digits}D)"


def std_of(total: str, squares: str, n: str, digits: int = 0) -> str:
    """Sample standard deviation; 0 below two values."""
    return f"(CASE WHEN {n} > 1 THEN sqrt({m2_of(total, squares, n, digits)} / ({n} - 1)) ELSE 0D END)"


def hour_rarity(same_hour: str, all_hours: str, registry: Registry = DEFAULT_REGISTRY) -> str:
    """1 - 24 p for the smoothed probability p of an hour."""
    a = registry.hour_alpha
    return f"(1D - 24D * (({same_hour} + {a}D) / ({all_hours} + {24 * a}D)))"


LOG_DIGITS = 12  # decimals of a log size that count


def log_size(size_bytes: str) -> str:
    return f"ln(cast(greatest({size_bytes}, 1) AS double))"


def histogram(counts: str, bins: int) -> str:
    """Fixed-length array from a map bin -> count; a missing map gives zeros."""
    return f"transform(sequence(0, {bins - 1}), b -> coalesce(element_at({counts}, b), 0L))"


DATE_HEADER = (
    r"(?s)^\s*(?:[A-Za-z]{3,9}\s*,)?\s*(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{2,4})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[A-Za-z]+)?"
)
# Zone names of mail date headers, minutes east of UTC.
ZONE_MINUTES = {
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def sender_local_time(header: str) -> str:
    """struct(epoch, hour, dow) of a mail date header; hour and weekday (0 = Monday) are on the
    sender's own clock.  All NULL when the header cannot be read; a missing or unknown zone counts
    as UTC.  One pattern run splits the header; arrays of at most one element bind the parts."""
    split_up = "concat_ws('\x01', " + ", ".join(f"'${i}'" for i in range(1, 8)) + ")"
    fields = f"split(regexp_replace({header}, {literal(DATE_HEADER + '.*$')}, {split_up}), '\x01')"
    names = ("day", "mon", "year", "hour", "min", "sec", "zone")
    parts = ", ".join(f"'{n}', get(f, {i})" for i, n in enumerate(names))
    named = f"transform(filter(array({fields}), f -> size(f) = 7), f -> named_struct({parts}))"
    year = (
        "CASE WHEN length(p.year) >= 4 THEN int(p.year) WHEN try_cast(p.year AS int) > 68 "
        "THEN 1900 + try_cast(p.year AS int) ELSE 2000 + try_cast(p.year AS int) END"
    )
    month = f"array_position(split('{MONTHS}', ' '), lower(left(p.mon, 3)))"
    date = f"try_to_timestamp(concat_ws('-', {year}, {month}, p.day), 'y-M-d')"
    zones = " ".join(f"WHEN '{z}' THEN {m}" for z, m in ZONE_MINUTES.items())
    offset = (
        "CASE WHEN p.zone RLIKE '^[+-][0-9]{4}$' THEN if(left(p.zone, 1) = '-', -1, 1) * "
        "(int(substr(p.zone, 2, 2)) * 60 + int(substr(p.zone, 4, 2))) "
        f"ELSE CASE upper(p.zone) {zones} ELSE 0 END END"
    )
    numbers = (
        f"named_struct('d', cast({date} AS date), 'h', try_cast(p.hour AS int), "
        f"'m', try_cast(p.min AS int), 's', if(p.sec = '', 0, try_cast(p.sec AS int)), 'o', {offset})"
    )
    ok = "v.d IS NOT NULL AND v.h < 24 AND v.m < 60 AND v.s < 60"
    epoch = "unix_date(v.d) * 86400L + v.h * 3600 + v.m * 60 + v.s - v.o * 60"
    result = (
        f"named_struct('epoch', if({ok}, {epoch}, NULL), 'hour', if({ok}, v.h, NULL), "
        f"'dow', if({ok}, weekday(v.d), NULL))"
    )
    bound = f"transform({named}, p -> {numbers})"
    none = "named_struct('epoch', cast(NULL AS bigint), 'hour', cast(NULL AS int), 'dow', cast(NULL AS int))"
    return f"coalesce(get(transform({bound}, v -> {result}), 0), {none})"
