"""Attribute-value rows into one typed row per entity.

An RDD combineByKey holds one register per catalogue attribute and entity. The cell mergers are associative and
commutative (the later save wins, on equal times the greater text), so duplicates are resolved on the map side and
what is shuffled is one register list per entity and map task, however many rows an entity has.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A catalogue with more attributes than this is refused: its registers would not be small.
MAX_ATTRIBUTES = 5_000
#: Entities whose registers one reducing task merges.
ENTITIES_PER_TASK = 200_000

# Words that state a truth value.
TRUE_WORDS = ("true", "yes", "on", "1", "y", "t")
FALSE_WORDS = ("false", "no", "off", "0", "n", "f")
# English month abbreviations in calendar order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_DATE_FORMS = re.compile(
    r"(?:(?P<y>\d{4})(?P<sep>[-/.]?)(?P<m>\d{2})(?P=sep)(?P<d>\d{2})"
    r"|(?P<d2>\d{1,2})[ -](?P<mon>[A-Za-z]{3})[A-Za-z]*\.?[ -](?P<y2>\d{4}))"
    r"(?:[T ]00:00(?::00(?:\.0+)?)?(?:Z|\+00:?00)?)?"
)
_INT = re.compile(r"[+-]?(?:\d+|\d{1,3}(?:,\d{2,3})+)(?:\.0*)?(?:[eE]\+?0*)?")
_DOUBLE = re.compile(r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d{1,3})?")


def bare(text: str | None) -> str | None:
    """The value inside its notation: outer blanks and JSON quotes removed; None for null, blank and the word null."""
    if text is None:
        return None
    text = text.strip()
    if text[:1] == '"':
        try:
            inside = json.loads(text)
        except ValueError:
            return None
        text = inside.strip() if isinstance(inside, str) else ""
    return None if text == "" or text.lower() == "null" else text


def as_string(text: str) -> str | None:
    return None if text[0] in "{[" and text[-1] in "}]" else text


def as_boolean(text: str) -> bool | None:
    word = text.lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def as_int(text: str) -> int | None:
    if not _INT.fullmatch(text):
        return None
    value = int(re.split(r"[.eE]", text.replace(",", ""))[0])
    return value if -(2**63) <= value < 2**63 else None


def as_double(text: str) -> float | None:
    return float(text.replace(",", ".")) if _DOUBLE.fullmatch(text) else None


def as_date(text: str) -> datetime.date | None:
    m = _DATE_FORMS.fullmatch(text)
    if not m:
        return None
    try:
        if m["y"]:
            return datetime.date(int(m["y"]), int(m["m"]), int(m["d"]))
        return datetime.date(int(m["y2"]), MONTHS.index(m["mon"].lower()) + 1, int(m["d2"]))
    except ValueError:
        return None


READERS: dict[str, tuple[Callable[[str], object], T.DataType]] = {
    "string": (as_string, T.StringType()),
    "boolean": (as_boolean, T.BooleanType()),
    "int": (as_int, T.LongType()),
    "double": (as_double, T.DoubleType()),
    "date": (as_date, T.DateType()),
}


def plain_key(col):
    """Attribute names compare without case, blanks, `_` and `-`."""
    return F.lower(F.regexp_replace(col, r"(?U)[\s_-]", ""))


def stripped(col):
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def wide_table(rows: DataFrame, catalogue: DataFrame, entity: str = "username", attribute: str = "pref_key", value: str = "pref_value", saved_at: str = "saved_at", name: str = "pref_key", kind: str = "value_type") -> DataFrame:
    """One row per entity with a typed column for each catalogue attribute.

    Null or blank entities and attributes outside the catalogue are left out; other columns of `rows` are ignored,
    whatever their names. A cell is the latest readable value, a null time counts as earliest, equal times give the
    greater text; exact doubles change nothing. An entity of which nothing is readable keeps a row of nulls. Empty
    input gives an empty table with all columns. A catalogue of unknown types raises ValueError.
    """
    spark = rows.sparkSession
    entries = catalogue.select(name, kind).filter(F.col(name).isNotNull()).orderBy(name).limit(MAX_ATTRIBUTES + 1).collect()
    if len(entries) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    slots = [e[0] for e in entries]
    kinds = [(e[1] or "").strip().lower() for e in entries]
    if unknown := sorted({k for k in kinds if k not in READERS}):
        raise ValueError(f"unknown value types: {unknown}")
    width, readers = len(slots), [READERS[k][0] for k in kinds]
    schema = T.StructType([T.StructField(entity, T.StringType()), *(T.StructField(s, READERS[k][1]) for s, k in zip(slots, kinds))])
    if not width:
        return rows.select(stripped(F.col(entity)).alias(entity)).filter(F.col(entity) != "").distinct()
    by_key = F.create_map(*(x for i, s in enumerate(slots) for x in (F.lit(re.sub(r"[\s_-]", "", s).lower()), F.lit(i))))
    cells = (
        rows.select(stripped(F.col(entity)).alias("e"), by_key[plain_key(F.col(attribute))].alias("slot"), F.col(value).cast("string").alias("v"), F.unix_micros(F.col(saved_at).cast("timestamp")).alias("at"))
        .filter((F.col("e") != "") & F.col("slot").isNotNull())
    )
    # as many reducers as keep a task's registers few, however small the session's setting is
    entities = cells.agg(F.approx_count_distinct("e")).first()[0]
    reducers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entities // ENTITIES_PER_TASK))
    never = -(2**63)

    def read(part: Iterable) -> Iterator:
        for e, slot, text, at in part:
            inside = bare(text)
            typed = None if inside is None else readers[slot](inside)
            yield e, (slot, never if at is None else at, inside, typed)

    def later(a, b):
        """The cell that stays, of two cells (time, text, typed value) or None."""
        return b if a is None or (b is not None and b[:2] > a[:2]) else a

    def put(registers: list, cell: tuple) -> list:
        slot, at, inside, typed = cell
        if typed is not None:
            registers[slot] = later(registers[slot], (at, inside, typed))
        return registers

    merged = cells.rdd.mapPartitions(read).combineByKey(
        lambda cell: put([None] * width, cell), put, lambda a, b: [later(x, y) for x, y in zip(a, b)],
        numPartitions=reducers,
    )
    return spark.createDataFrame(merged.map(lambda kv: (kv[0], *(None if c is None else c[2] for c in kv[1]))), schema, verifySchema=False)


def cells_as_text(wide: DataFrame, entity: str = "username", attribute: str = "pref_key", value: str = "pref_value") -> DataFrame:
    """The non-null cells as (entity, attribute, text): doubles with two decimals, dates as yyyy-MM-dd."""
    cells = [F.struct(F.lit(f.name).alias(attribute), (F.format_string("%.2f", F.col(f.name)) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast("string")).alias(value), F.col(f.name).isNotNull().alias("there")) for f in wide.schema.fields if f.name != entity]
    return wide.select(entity, F.explode(F.array(*cells)).alias("c")).filter("c.there").select(entity, f"c.{attribute}", f"c.{value}")
