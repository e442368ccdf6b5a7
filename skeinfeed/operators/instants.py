"""Written moments in any of several forms into one UTC instant.

All forms are one regular expression with named groups; a single replacement pass turns a text into its components,
which are checked against the calendar and put together by integer day arithmetic. Everything stays in the JVM.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinfeed.session import small

# English month abbreviations in calendar order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Zone abbreviations and their minutes east of Greenwich, in their most common meaning.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "gst": 240, "pkt": 300, "ist": 330, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540,
    "kst": 540, "acst": 570, "aest": 600, "acdt": 630, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
# Other meanings where the source's home zone starts with the text.
LOCAL_ABBREVIATIONS = {
    "Australia/": {"est": 600, "edt": 660, "cst": 570, "cdt": 630, "wst": 480},
    "Europe/Dublin": {"ist": 60},
    "Asia/Jerusalem": {"ist": 120, "idt": 180},
    "Asia/Shanghai": {"cst": 480},
    "Asia/Dhaka": {"bst": 360},
    "Asia/Manila": {"pst": 480},
}

PARTS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone", "region", "epoch", "one", "two")
_MARK = "\u0001"
_ZONE = r"(?:\s*(?<{p}zone>[+-]\d{{2}}:?\d{{2}}|[+-]\d{{2}}|[a-z]{{1,5}}(?![a-z/_])(?:[+-]\d{{1,2}}(?::?\d{{2}})?)?))?(?:\s*\[?(?<{p}region>[a-z]+(?:[/_+-][a-z0-9]+)+)\]?)?"
_CLOCK = r"(?<{p}hour>\d{{1,2}}):(?<{p}minute>\d{{2}})(?::(?<{p}second>\d{{2}})(?:[.,](?<{p}fraction>\d{{1,9}}))?)?"
_HALF = r"(?:\s*(?<{p}half>[ap]\.?m\.?)(?![a-z]))?"
_MONTH = r"(?<{p}month>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: name, pattern; {p} becomes a prefix that keeps the group names apart.
FORMS = {
    "iso": r"(?<{p}year>\d{{4}})-(?<{p}month>\d{{1,2}})-(?<{p}day>\d{{1,2}})(?:\s*t\s*|\s+)" + _CLOCK + _HALF + _ZONE,
    "big": r"(?<{p}year>\d{{4}})/(?<{p}month>\d{{1,2}})/(?<{p}day>\d{{1,2}})(?:t|\s+)" + _CLOCK + _HALF + _ZONE,
    "basic": r"(?<{p}year>\d{{4}})(?<{p}month>\d{{2}})(?<{p}day>\d{{2}})t(?<{p}hour>\d{{2}})(?<{p}minute>\d{{2}})(?:(?<{p}second>\d{{2}})(?:[.,](?<{p}fraction>\d{{1,9}}))?)?" + _ZONE,
    "mail": r"(?:[a-z]{{2,9}}\.?,?\s+)?(?<{p}day>\d{{1,2}})[\s-]+" + _MONTH + r"[\s-]+(?<{p}year>\d{{4}})(?:,|\s+at)?\s+" + _CLOCK + _HALF + _ZONE,
    "month": r"(?:[a-z]{{3,9}}\.?,?\s+)?" + _MONTH + r"\s+(?<{p}day>\d{{1,2}}),?\s+(?<{p}year>\d{{4}})(?:,|\s+at)?\s+" + _CLOCK + _HALF + _ZONE,
    "slash": r"(?<{p}one>\d{{1,2}})/(?<{p}two>\d{{1,2}})/(?<{p}year>\d{{4}})(?:,\s*|t|\s+)" + _CLOCK + _HALF + _ZONE,
    "dots": r"(?<{p}day>\d{{1,2}})\.(?<{p}month>\d{{1,2}})\.(?<{p}year>\d{{4}})(?:,\s*|t|\s+)" + _CLOCK + _HALF + _ZONE,
    "epoch": r"(?<{p}epoch>\d{{9,11}}|\d{{12,14}})",
}


def _compiled() -> tuple[str, str]:
    """The alternation over all forms, and the replacement that writes the parts in order."""
    patterns, names = [], {part: "" for part in PARTS}
    for form, pattern in FORMS.items():
        patterns.append(pattern.format(p=form))
        for part in PARTS:
            if f"(?<{{p}}{part}>" in pattern:
                names[part] += f"${{{form}{part}}}"
    return rf"(?isU)\A(?:{'|'.join(patterns)})\z", _MARK + _MARK.join(names[p] for p in PARTS)


def _case_regions() -> dict[str, str]:
    return {name.lower(): name for name in sorted(zoneinfo.available_timezones()) if "/" in name and not name.startswith(("posix/", "right/"))}


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar, in integers."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468


def _regions() -> Column:
    return F.create_map(*(F.lit(x) for kv in _case_regions().items() for x in kv))


def _with_instant(rows: DataFrame, text: str, out: str) -> DataFrame:
    """`rows` (with _home_zone, _home_place and _date_order) with `out`; one step of columns builds on the one before."""
    pattern, replacement = _compiled()
    tidy = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    rows = rows.withColumn("_parts", F.split(F.regexp_replace(tidy, pattern, replacement), _MARK))
    rows = rows.withColumn("_at", F.when(F.size("_parts") == len(PARTS) + 1, F.transform("_parts", lambda x: F.nullif(x, F.lit("")))))
    at = {name: F.get("_at", F.lit(i + 1)) for i, name in enumerate(PARTS)}
    number = lambda c: c.try_cast("bigint")
    us = F.lower(F.coalesce("_date_order", F.lit("dmy"))) == "mdy"
    month_word = F.create_map(*(x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1).cast("bigint"))))
    one, two = number(at["one"]), number(at["two"])
    rows = rows.withColumns({
        "_year": number(at["year"]),
        "_month": F.coalesce(number(at["month"]), month_word[F.lower(at["month"])], F.when(us, one).otherwise(two)),
        "_day": F.coalesce(number(at["day"]), F.when(us, two).otherwise(one)),
        "_clock": number(at["hour"]),
        "_minute": number(at["minute"]),
        "_second": F.coalesce(number(at["second"]), F.lit(0).cast("bigint")),
        "_micros": number(F.substring(F.rpad(F.coalesce(at["fraction"], F.lit("")), 9, "0"), 1, 6)),
        "_half": F.lower(F.substring(at["half"], 1, 1)),
        "_zone": F.lower(at["zone"]),
        "_region": at["region"],
        "_epoch": at["epoch"],
    })
    year, month, day, half, zone = (F.col(c) for c in ("_year", "_month", "_day", "_half", "_zone"))
    clock = F.col("_clock")
    hour = F.when(half.isNull(), clock).when(clock.between(1, 12), clock % 12 + F.when(half == "p", 12).otherwise(0))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    month_days = F.get(F.array(*(F.lit(x) for x in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), (month - 1).cast("int")) + F.when(leap & (month == 2), 1).otherwise(0)
    valid = (year >= 1) & month.between(1, 12) & (day >= 1) & (hour <= 23) & (F.col("_minute") <= 59) & (F.col("_second") <= 59)
    rows = rows.withColumn("_valid", valid & F.when(valid, day <= month_days)).withColumn("_hour", hour)
    local = (days_from_civil(year, month, day) * 86400 + F.col("_hour") * 3600 + F.col("_minute") * 60 + F.col("_second")) * 1_000_000 + F.col("_micros")
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    sign = F.when(F.contains(zone, F.lit("-")), -1).otherwise(1)
    hours = number(F.when(F.length(digits) % 2 == 1, F.substring(digits, 1, 1)).otherwise(F.substring(digits, 1, 2)))
    minutes = F.when(F.length(digits) >= 3, number(F.substring(digits, -2, 2))).otherwise(0)
    shift = sign * (hours * 60 + minutes)
    table_of = lambda words: F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.lit(v).cast("bigint"))))
    named = table_of(ABBREVIATIONS)[zone]
    for start, own in LOCAL_ABBREVIATIONS.items():
        named = F.when(F.col("_home_zone").startswith(start), F.coalesce(table_of(own)[zone], named)).otherwise(named)
    rows = rows.withColumns({
        "_local": F.when(F.col("_valid"), local.cast("bigint")),
        "_offset": F.when(zone.rlike("[+-]"), F.when(shift.between(-18 * 60, 18 * 60), shift)).when(zone.isNotNull(), named),
        "_place": F.when(F.col("_region").isNotNull(), _regions()[F.lower("_region")]).when(zone.isNull(), F.col("_home_place")),
    })
    by_zone = F.when(F.col("_place").isNotNull() & F.col("_local").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_place"))))
    epoch = number(F.col("_epoch"))
    from_epoch = F.when(F.length("_epoch") <= 11, epoch * 1_000_000).otherwise(epoch * 1000)
    instant = F.when(F.col("_epoch").isNotNull(), from_epoch).when(zone.isNotNull(), F.col("_local") - F.col("_offset") * 60_000_000).otherwise(by_zone)
    gone = ["_parts", "_at", "_year", "_month", "_day", "_clock", "_minute", "_second", "_micros", "_half", "_zone", "_region", "_epoch", "_valid", "_hour", "_local", "_offset", "_place"]
    return rows.withColumn(out, instant).drop(*gone)


def normalised_instants(rows: DataFrame, sources: DataFrame, text: str = "published_at", source: str = "source", out: str = "epoch_us") -> DataFrame:
    """`rows` with the column `out`: microseconds since 1970-01-01 UTC of the instant that each `text` fixes, or null.

    Without zone the time is wall time in the home zone of its source (source null, unlisted or without a known zone: no
    result); of an hour that occurs twice the first pass, a skipped wall time with the offset before the change. Null,
    and empty texts, days without a time, impossible dates and relative words give null. Sources compare
    without case and outer blanks; a source listed twice counts once. Columns of `rows` keep names and values, an old
    column named `out` is replaced; names beginning with an underscore are kept for the operator's steps.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    homes = sources.select(plain(F.col("source")).alias("_home_key"), F.col("home_zone").alias("_home_zone"), _regions()[F.lower("home_zone")].alias("_home_place"), F.col("date_order").alias("_date_order")).filter("_home_key is not null").dropDuplicates(["_home_key"])
    joined = rows.withColumn("_source_key", plain(F.col(source))).join(small(homes), F.col("_source_key") == F.col("_home_key"), "left")
    return _with_instant(joined, text, out).drop("_source_key", "_home_key", "_home_zone", "_home_place", "_date_order")
