"""Value coercion: every comparison goes through a number or a string form of the stored value."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: With the zone at their end, which is added where the text has none: what a date means doesn't depend on the session.
DATE_FORMATS = [("yyyy-MM-dd H:mm:ss[.SSS]XXX", "Z"), ("yyyy-MM-dd'T'H:mm:ss[.SSS]XXX", ""), ("yyyy-MM-dd'T'H:mm:ss[.SSS]XXX", "Z"), ("yyyy-MM-dd H:mm:ssXXX", " 00:00:00Z")]
DAY = 86_400_000
#: A time alone belongs to the year 0; Spark takes it as 1970.
YEAR_ZERO_MS = 62_167_219_200_000
NUMBER = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
_PY_DATE = re.compile(r"^(\d{4})-(\d\d)-(\d\d)(?:([ T])(\d{1,2}):(\d\d):(\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:\d\d)?)?$")
_PY_TIME = re.compile(r"^(\d{1,2}):(\d\d):(\d\d)(?:[.,](\d+))?$")


def date_millis(text: Column) -> Column:
    """Milliseconds since 1970 of a date string, else null."""
    full = F.coalesce(*[F.try_to_timestamp(F.concat(text, F.lit(zone)), F.lit(f)) for f, zone in DATE_FORMATS])
    clock = F.unix_millis(F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), text, F.lit("Z")), F.lit("yyyy-MM-dd H:mm:ss[.SSS]XXX"))) - YEAR_ZERO_MS
    ms = F.when(F.substring(text, 5, 1) == "-", F.unix_millis(full)).otherwise(clock)
    return F.when(F.octet_length(text).between(8, 35) & text.rlike("^[0-9]") & text.rlike("^[0-9:T +.Z-]+$"), ms)


def utc_text(ms: Column, between: str, end: str = "", always: bool = False) -> Column:
    """Milliseconds as date and time in UTC, whatever the session's zone. always: with .000 too."""
    day = F.floor(ms / DAY)
    rest = (ms - day * DAY).cast("long")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")
    milli = F.concat(F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"))
    tail = milli if always else F.when(rest % 1000 > 0, milli).otherwise("")
    return F.concat(date, F.lit(between), two(rest / 3_600_000), F.lit(":"), two(rest / 60_000 % 60), F.lit(":"), two(rest / 1000 % 60), tail, F.lit(end))


def truncated(ms: Column, unit: str) -> Column:
    """Milliseconds at which the year, month, week (from Monday), day, hour or minute began in UTC."""
    if unit in ("year", "month"):
        date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY).cast("int"))
        return F.unix_date(F.trunc(date, unit)).cast("long") * DAY
    size, shift = {"week": (7 * DAY, 3 * DAY), "hour": (3_600_000, 0), "minute": (60_000, 0)}.get(unit, (DAY, 0))
    return (F.floor((ms + shift) / size) * size - shift).cast("long")


def string_number(text: Column) -> Column:
    return F.coalesce(date_millis(text).cast("double"), F.when(text.rlike(NUMBER), text.try_cast("double")))


def number_string(x: Column) -> Column:
    """A double without exponent and trailing zeros."""
    plain = x.cast("string")
    wide = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).when(plain.contains("E"), F.coalesce(wide, plain)).otherwise(plain)


def py_date_millis(text: str) -> int | None:
    if not 8 <= len(text.encode()) <= 35:
        return None
    try:
        if m := _PY_DATE.match(text):
            y, mo, d, sep, h, mi, s, frac, zone = m.groups()
            if sep == " " and zone:
                return None
            at = dt.datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), tzinfo=dt.timezone.utc)
            ms = int((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds()) * 1000 + int(((frac or "0") + "00")[:3])
            if zone and zone != "Z":
                ms -= (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[4:])) * 60_000
            return ms
        if m := _PY_TIME.match(text):
            h, mi, s, frac = m.groups()
            dt.time(int(h), int(mi), int(s))
            return (int(h) * 3600 + int(mi) * 60 + int(s)) * 1000 + int(((frac or "0") + "00")[:3]) - YEAR_ZERO_MS
    except ValueError:
        return None
    return None


def py_number(v) -> float | None:
    """The number of a request value: numbers, booleans, dates and numeric strings have one."""
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        ms = py_date_millis(v)
        if ms is not None:
            return float(ms)
        return float(v) if re.match(NUMBER, v) else None
    return None


def py_string(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return str(int(v))
    return json.dumps(v, ensure_ascii=False)


def py_text(v) -> str:
    """A request value where a query text is wanted: null is empty."""
    return "" if v is None else py_string(v)


def option(body: dict, key: str, default: float) -> float:
    v = py_number(body[key]) if key in body else None
    return default if v is None else v


@dataclass(frozen=True)
class Values:
    """The stored values of one path. kind: string, long, double, bool, time or json (literals of any type, as strings)."""

    raw: Column
    kind: str
    many: bool
    flags: bool = False  # json literals of a boolean field
    zone: str = ""  # of times: ltz (a moment), ntz (without a zone, taken as UTC) or date

    def _each(self, f: Callable[[Column], Column]) -> Column:
        return F.transform(self.raw, f) if self.many else f(self.raw)

    def strings(self) -> Column:
        """String forms; an array if there are many values."""
        if self.kind in ("string", "json"):
            return self.raw
        return self._each(self._string)

    def _string(self, x: Column) -> Column:
        if self.kind == "time":
            return utc_text(self._millis(x), " ")
        return number_string(x.cast("double")) if self.kind == "double" else x.cast("string")

    def _number(self, x: Column) -> Column:
        if self.kind == "time":
            return self._millis(x).cast("double")
        if self.kind == "bool":
            return x.cast("int").cast("double")
        if self.kind in ("string", "json"):
            n = string_number(x)
            return F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(n) if self.flags else n
        return x.cast("double")

    def _millis(self, x: Column) -> Column:
        """Of a stored time; those without a zone are taken as UTC, not as the session's."""
        if self.zone == "date":
            return F.unix_date(x).cast("long") * DAY
        if self.zone == "ntz":
            second = F.floor(F.date_part(F.lit("SECOND"), x) * 1000).cast("long")
            return F.unix_date(x.cast("date")).cast("long") * DAY + F.hour(x) * 3_600_000 + F.minute(x) * 60_000 + second
        return F.unix_millis(x)

    def moment(self, micros: int) -> Column | None:
        """A literal that a stored time can be compared with as it is; None if there is none."""
        try:
            at = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)
        except OverflowError:
            return None
        return F.expr(f"timestamp_ntz'{at.isoformat(sep=' ')}'") if self.zone == "ntz" else F.timestamp_micros(F.lit(micros)) if self.zone == "ltz" else None

    def numbers(self) -> Column:
        """Numbers, null where a value has none; an array if there are many values."""
        return self._each(self._number)

    def millis(self) -> Column:
        """Dates as milliseconds; only strings and times have them."""
        if self.kind == "time":
            return self._each(self._millis)
        if self.kind in ("string", "json"):
            return self._each(date_millis)
        return self._each(lambda x: F.lit(None).cast("long"))

    def any(self, f: Callable[[Column, Column], Column], number: bool = True) -> Column:
        """Whether f(number, string) holds for any value; null or false if it doesn't."""
        test = lambda x: f(self._number(x) if number else x, x if self.kind in ("string", "json") else self._string(x))
        return F.exists(self.raw, lambda x: F.coalesce(test(x), F.lit(False))) if self.many else test(self.raw)

    def first(self) -> Column:
        """The number of the first value, null if it has none."""
        return self._number(F.get(self.raw, F.lit(0))) if self.many else self._number(self.raw)

    def count(self) -> Column:
        return F.coalesce(F.size(self.raw), F.lit(0)) if self.many else self.raw.isNotNull().cast("int")


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.IntegralType):
        return "long"
    return "double" if isinstance(t, T.NumericType) else None


def zone_of(t: T.DataType) -> str:
    return "ltz" if isinstance(t, T.TimestampType) else "ntz" if isinstance(t, T.TimestampNTZType) else "date" if isinstance(t, T.DateType) else ""
