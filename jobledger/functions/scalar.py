"""Scalar column builders: ids, dates, buckets, sizes, durations, formats."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Patterns a value must fit to count as a date, number or id.
KIND_PATTERNS = {
    "yyyymmdd": r"^20[0-9][0-9][0-1][0-9][0-3][0-9]$",
    "yyyy": r"^20[0-9][0-9]$",
    "mm": r"^(0[1-9]|1[012])$",
    "dd": r"^(0[1-9]|[12][0-9]|3[01])$",
    "float": r"(^[-]?\d+\.\d*$|^\d*\.{1,1}\d+$)",
    "int": r"(^[0-9-]$|^[0-9-][0-9]*$)",
    "uid": r"^[a-z0-9]{32,32}$",
}
# Exit codes that say nothing.
INVALID_EXIT_CODES = ["None", "99999"]
# Size units for both bases.
SIZE_UNITS = {10: ["", "KB", "MB", "GB", "TB", "PB"], 2: ["", "KiB", "MiB", "GiB", "TiB", "PiB"]}

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def document_id(*names: str) -> Column:
    """md5 of the fields as JSON with sorted keys, so field order does not matter."""
    return F.md5(F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"}))


def random_id() -> Column:
    """A random id of 32 hex digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def timestamp_of(epoch: Column) -> Column:
    """Epoch seconds as a zone-free (UTC) timestamp."""
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), epoch.cast("decimal(18,6)"))


def date_path(day: Column) -> Column:
    return F.date_format(day, "yyyy/MM/dd")


def date_range(first: Column, last: Column) -> Column:
    """All dates from first to last, both included; a reversed range is an error."""
    return F.when(first > last, F.raise_error(F.lit("date range is reversed"))).otherwise(
        F.sequence(first, last))


def epoch_of(text: Column, now: Column) -> Column:
    """``YYYYMMDD`` or ``Nd`` (N days before now) as epoch seconds; null when neither."""
    text = F.lower(text)
    day = F.when(text.rlike(KIND_PATTERNS["yyyymmdd"]),
                 F.try_to_date(text, "yyyyMMdd"))
    days = F.regexp_extract(text, r"^(-?\d+)d$", 1).try_cast("bigint")
    return F.coalesce(F.unix_date(day).cast("bigint") * 86400, now.cast("bigint") - days * 86400)


def parse_day(value: int | str | dt.date, today: dt.date) -> dt.date:
    """Plan-time form of :func:`epoch_of`: a date key as a date, or ValueError."""
    if isinstance(value, dt.date):
        return value
    text = str(value).lower()
    if re.match(KIND_PATTERNS["yyyymmdd"], text):
        return dt.datetime.strptime(text, "%Y%m%d").date()
    if re.match(r"^\d+d$", text):
        return today - dt.timedelta(days=int(text[:-1]))
    raise ValueError(f"{value!r} is neither YYYYMMDD nor a number of days such as 3d")


def matches_kind(value: Column, kind: str) -> Column:
    return value.cast("string").rlike(KIND_PATTERNS[kind])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times, as a lambda variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rounded_tenths(scaled: Column) -> Column:
    """Tenths of a number given as ten times its 2**52-fold, ties to even."""
    unit, half = F.lit(2 ** 52).cast("decimal(17,0)"), F.lit(2 ** 51).cast("decimal(17,0)")
    rest = scaled % unit
    floor = ((scaled - rest) / unit).cast("bigint")
    return floor + F.when((rest > half) | ((rest == half) & (floor % 2 == 1)), 1).otherwise(0)


def _one_decimal(value: Column) -> Column:
    """One decimal with exact ties to even, as C's printf rounds.

    Scaling by 2**52 is exact, so the tenths come from whole-number arithmetic
    on the binary value itself.
    """
    small = F.when(F.abs(value) < 1024, F.abs(value)).otherwise(0.0)
    scaled = (small * F.lit(2.0 ** 52)).cast("bigint").cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)")
    text = let(let(scaled, _rounded_tenths), lambda t: F.format_string("%d.%d", F.floor(t / 10), t % 10))
    exact = F.concat(F.when(value < 0, "-").otherwise(""), text)
    return F.when(F.abs(value) < 1024, exact).otherwise(F.format_string("%.1f", value))


def _human_size(number: Column, base: int) -> Column:
    step = 1000.0 if base == 10 else 1024.0
    scaled = unit = None
    for power, name in enumerate(SIZE_UNITS[base]):
        fits = number < step ** (power + 1)
        scaled = F.when(fits, number / F.lit(step ** power)) if power == 0 else scaled.when(fits, number / F.lit(step ** power))
        unit = F.when(fits, name) if power == 0 else unit.when(fits, name)
    return F.when(number.isNull(), "N/A").otherwise(F.concat(let(scaled, _one_decimal), unit))


def human_size(value: Column, base: int = 10) -> Column:
    """Bytes with a unit and one decimal; N/A when not a number, null beyond the last unit."""
    return let(value.try_cast("double"), lambda number: _human_size(number, base))


def human_duration(seconds: Column) -> Column:
    """Whole seconds as ``1 day, 2 hours, ...`` without zero parts."""
    whole = seconds.cast("bigint")
    parts = [
        ("day", F.floor(whole / 86400)),
        ("hour", F.floor(whole / 3600) % 24),
        ("minute", F.floor(whole / 60) % 60),
        ("second", whole % 60),
    ]
    return F.concat_ws(", ", *[
        F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise("")))
        for name, n in parts
    ])


def bucket_start(when: Column, precision: str) -> Column:
    if precision not in ("hour", "day", "week", "month"):
        raise ValueError(f"no such precision: {precision}")
    # By the calendar date, not by an instant: the session's time zone has no say in it.
    day = when.cast("date")
    if precision == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(when))
    return (F.trunc(day, precision) if precision in ("week", "month") else day).cast("timestamp_ntz")


def bucket_end(start: Column, precision: str) -> Column:
    if precision == "month":
        return F.add_months(start.cast("date"), 1).cast("timestamp_ntz")
    length = {"hour": "interval 1 hour", "day": "interval 1 day", "week": "interval 7 days"}[precision]
    return start + F.expr(length)


def instant_of(when: Column) -> Column:
    """A zone-free (UTC) timestamp as an instant, whatever the session's time zone."""
    seconds = F.unix_date(when.cast("date")).cast("bigint") * 86400 + F.hour(when) * 3600 + F.minute(when) * 60
    return F.timestamp_seconds(seconds + F.extract(F.lit("SECOND"), when))


def iso_ts(when: Column) -> Column:
    """A zone-free timestamp as ISO text with milliseconds."""
    text = when.cast("timestamp_ntz").cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."),
                    F.rpad(F.substring(text, 21, 3), 3, "0"), F.lit("Z"))


def cutoff(interval: str, now: dt.datetime) -> dt.datetime:
    """``Nh``, ``Nd`` or ``Nm`` before now; a month counts as five weeks."""
    found = re.fullmatch(r"(\d+)([hdm])", interval)
    if not found:
        raise ValueError(f"unsupported interval {interval!r}: use h, d or m")
    number = int(found.group(1))
    unit = {"h": dt.timedelta(hours=1), "d": dt.timedelta(days=1), "m": dt.timedelta(weeks=5)}
    return now - number * unit[found.group(2)]


def cutoff_column(interval: Column, now: Column) -> Column:
    """Row form of :func:`cutoff`; null where the text is no interval."""
    number = F.regexp_extract(interval, r"^(\d+)[hdm]$", 1).try_cast("int")
    hours = (F.when(interval.endswith("h"), number)
             .when(interval.endswith("d"), number * 24)
             .when(interval.endswith("m"), number * 24 * 35))
    return now - F.make_dt_interval(F.lit(0), hours)


def valid_exit_code(code: Column) -> Column:
    return code.isNotNull() & ~code.cast("string").isin(INVALID_EXIT_CODES)


def all_have_ext(files: Column, ext: str) -> Column:
    """Whether a non-empty list of files all end with the extension."""
    return (F.size(files) > 0) & F.forall(files, lambda f: f.endswith(ext))


def file_class(files: Column) -> Column:
    """``root``, ``log`` or null: what a list of files lets a trace look for."""
    return (F.when(all_have_ext(files, "root"), "root")
            .when(all_have_ext(files, "tar.gz") | all_have_ext(files, "tar"), "log"))


def step_kind(name: Column) -> Column:
    """A step name without its trailing number."""
    return F.regexp_replace(name, "[0-9]+$", "")


def is_cmsrun(name: Column) -> Column:
    return F.lower(name).startswith("cmsrun")


def _decimals(value: Column, places: int = 2) -> Column:
    """Up to ``places`` decimals, without trailing zeros."""
    fixed = F.format_string(f"%.{places}f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _scaled(value: Column, names: list[str]) -> Column:
    shown = None
    for power in range(len(names) - 1, 0, -1):
        test = F.abs(value) >= 1000.0 ** power
        text = F.concat(_decimals(value / F.lit(1000.0 ** power)), F.lit(names[power]))
        shown = F.when(test, text) if shown is None else shown.when(test, text)
    return shown.otherwise(F.concat(_decimals(value), F.lit(names[0])))


def _clock(seconds: Column) -> Column:
    whole = F.round(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def format_metric(value: Column, unit: Column) -> Column:
    """A metric value as text, scaled by its unit."""
    value = value.cast("double")
    sizes = [" B", " KB", " MB", " GB", " TB", " PB"]
    counts = ["", "k", "m", "b", "t"]
    return (
        F.when(value.isNull(), None)
        .when(unit == "s", F.concat(_clock(value), F.lit(" ("), F.format_string("%.1f", value), F.lit("s)")))
        .when(unit == "%", F.concat(_decimals(value), F.lit("%")))
        .when(unit == "MB", _scaled(value * 1e6, sizes))
        .when(unit == "KB", _scaled(value * 1e3, sizes))
        .when(unit == "MB/ms", F.concat(_scaled(value * 1e6, sizes), F.lit("/ms")))
        .when(unit == "ms", F.concat(_scaled(value, counts), F.lit(" ms")))
        .when(unit == "microseconds", _clock(value * 1e-6))
        .otherwise(F.concat(_scaled(value, counts), unit))
    )


def scope_json(*names: str) -> Column:
    """Scope fields as JSON with dates in ISO form and nulls kept."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]),
                     {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def scope_hash(*names: str) -> Column:
    return F.md5(scope_json(*names))
