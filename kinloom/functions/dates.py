"""Partial dates as column expressions: normalising, parsing, comparing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations, month words, rewriting rules and grammars of the format.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
MONTH_WORDS = {
    "JAN": ("january", "januar", "janvier"),
    "FEB": ("february", "février", "fevrier", "févr"),
    "MAR": ("march", "märz", "mär"),
    "APR": ("april", "avril"),
    "MAY": ("may", "mai"),
    "JUN": ("june", "juni", "juin"),
    "JUL": ("july", "juli", "juillet"),
    "AUG": ("august", "août", "aout", "ago"),
    "SEP": ("september", "septembre", "sept"),
    "OCT": ("october", "oktober", "octobre"),
    "NOV": ("november", "novembre"),
    "DEC": ("december", "dezember", "décembre", "déc"),
}
RULES = [
    (r"(?i)^(about|around|abt\.?|circa|ca\.?|approx\.?|maybe)\s+", "ABT "),
    (r"(?i)^(before|bef\.?)\s+", "BEF "),
    (r"(?i)^(after|aft\.?)\s+", "AFT "),
    (r"^(\d{4})-(\d{4})$", "BET $1 AND $2"),
    (r"(?i)^bet\.?\s+(\d{3,4})-(\d{3,4})$", "BET $1 AND $2"),
    (r"(?i)^between\s+(\d{3,4})-(\d{3,4})$", "BET $1 AND $2"),
    (r"(?i)^bet(?:ween)?\.?\s+(.+?)\s+and\s+(.+)$", "BET $1 AND $2"),
    (r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.", "$1"),
    (r"(?i)\bthe\s+(\d{1,2}(?:st|nd|rd|th)?)\s+of\s+", "$1 "),
    (r"(?i)(\d{1,2})(?:st|nd|rd|th)(\s+)", "$1$2"),
    (r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})$", "$2 $1 $3"),
    (r"^(\d{1,2})\s+([A-Za-z]+),\s*(\d{4})$", "$1 $2 $3"),
    (r"^(\d{4})\s+([A-Za-z]+)\s+(\d{1,2})$", "$3 $2 $1"),
    (r"^([A-Za-z]+)\s+(\d{1,2})\s+(\d{4})$", "$2 $1 $3"),
    (r"(?i)^(BEF|AFT|ABT|CAL|EST|INT)\s+([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})$", "$1 $3 $2 $4"),
    (r"(?i)^(BEF|AFT|ABT|CAL|EST|INT)\s+([A-Za-z]+)\s+(\d{1,2})\s+(\d{4})$", "$1 $3 $2 $4"),
    (r"(?i)^(BEF|AFT|ABT|CAL|EST|INT)\s+(\d{1,2})\s+([A-Za-z]+),\s*(\d{4})$", "$1 $2 $3 $4"),
]
_MONTH = "(?:" + "|".join(MONTHS) + ")"
GRAMMAR = rf"(?i)^(BET .+ AND .+|FROM .+|(ABT|CAL|EST|BEF|AFT|INT)? ?\d{{0,2}} ?{_MONTH} \d{{1,4}}|(ABT|CAL|EST|BEF|AFT|INT)? ?\d{{1,4}})$"
YEAR = r"\b\d{3,4}\b"
AGE = r"(?i)^[<>]?(\d+y(\s+\d+m)?(\s+\d+d)?|\d+m(\s+\d+d)?|\d+d|CHILD|INFANT|STILLBORN)$"
VIEWER_AGE = r"(?i)^[<>]?\s*(\d+y(\s+\d+m)?(\s+\d+d)?|\d+m(\s+\d+d)?|\d+d|CHILD|INFANT|STILLBORN)$"

DATE = "struct<qualifier:string,year:int,month:int,day:int,year2:int>"


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), number)


def month_number(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(name)).cast("int")
    return F.when(at > 0, at)


def upper_months(value: Column) -> Column:
    """Month abbreviations in capitals."""
    return reduce(lambda v, m: F.regexp_replace(v, rf"(?i)\b{m}\b", m), MONTHS, value)


def normalize_date(value: Column) -> Column:
    """A date as people write it, in the format's grammar where a rule says how."""
    v = F.trim(value)
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    number = lambda x, p, k: F.regexp_extract(x, p, k).try_cast("int")
    from_parts = lambda x, p, d, m, y: F.when(x.rlike(p) & number(x, p, m).between(1, 12), F.concat_ws(" ", number(x, p, d).cast("string"), month_name(number(x, p, m)), F.regexp_extract(x, p, y))).otherwise(x)
    v = from_parts(v, iso, 3, 2, 1)
    v = from_parts(v, slash, 2, 1, 3)
    v = F.regexp_replace(v, r"^\s*(.+\d{4})\s*-\s*(.+\d{4})$", "BET $1 AND $2")
    for pattern, to in RULES:
        v = F.regexp_replace(v, pattern, to)
    for short, words in MONTH_WORDS.items():
        v = F.regexp_replace(v, r"(?iU)\b(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")\b", short)
    return F.trim(F.regexp_replace(upper_months(v), r"\s{2,}", " "))


def _simple(s: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of D MON Y, MON Y or Y."""
    pattern = r"^(?:(?:(\d{1,2})\s+)?([A-Z]{3})\s+)?(\d{3,4})$"
    part = lambda k: F.regexp_extract(s, pattern, k)
    return part(3).try_cast("int"), month_number(F.nullif(part(2), F.lit(""))), part(1).try_cast("int")


def parse_date(value: Column) -> Column:
    """A struct of qualifier (null: exact), year, month, day and year2; null where nothing is a date. FROM a TO b
    is BET, FROM a is AFT, CAL, EST and ABOUT are ABT, an unknown month is null, a lone TO is no date."""
    v = F.upper(F.trim(value))
    span = r"^(?:BET(?:WEEN)?\s+(.+?)\s+AND|FROM\s+(.+?)\s+TO)\s+(.+)$"
    is_span = v.rlike(span)
    qualifier = (
        F.when(is_span, "BET").when(v.rlike(r"^FROM\s"), "AFT").when(v.rlike(r"^(ABT|ABOUT|CAL|EST)\.?\s"), "ABT").when(v.rlike(r"^BEF\.?\s"), "BEF").when(v.rlike(r"^AFT\.?\s"), "AFT")
    )
    first = F.when(is_span, F.concat(F.regexp_extract(v, span, 1), F.regexp_extract(v, span, 2))).otherwise(F.regexp_replace(v, r"^(FROM|ABT|ABOUT|CAL|EST|BEF|AFT)\.?\s+", ""))
    y, m, d = _simple(F.trim(first))
    y2 = F.when(is_span, _simple(F.trim(F.regexp_extract(v, span, 3)))[0])
    return F.when(y.isNotNull(), F.struct(qualifier.alias("qualifier"), y.alias("year"), m.alias("month"), d.alias("day"), y2.alias("year2")))


def specificity(d: Column) -> Column:
    """How much a date says: its qualifier, year, month and day count 8 (none), 2, 1; 1; 2; 4."""
    of = F.when(d["qualifier"].isNull(), 8).when(d["qualifier"] == "ABT", 2).when(d["qualifier"].isin("BEF", "AFT"), 1).otherwise(0)
    return F.when(d.isNull(), 0).otherwise(of + d["year"].isNotNull().cast("int") + 2 * d["month"].isNotNull().cast("int") + 4 * d["day"].isNotNull().cast("int"))


def year_range(d: Column) -> tuple[Column, Column]:
    q, y = d["qualifier"], d["year"]
    low = F.when(q == "BEF", 0).when(q == "ABT", y - 2).otherwise(y)
    high = F.when(q == "BET", F.coalesce(d["year2"], y)).when(q == "AFT", 9999).when(q == "ABT", y + 2).otherwise(y)
    return low, high


def date_overlap(a: Column, b: Column) -> Column:
    """How well two dates agree, 0 to 1; 0.3 if one is missing."""
    exact = lambda d: d["qualifier"].isNull()
    (al, ah), (bl, bh) = year_range(a), year_range(b)
    same = F.when((a["year"] == b["year"]) & (a["month"] == b["month"]) & (a["day"] == b["day"]), 1.0).when((a["year"] == b["year"]) & (a["month"] == b["month"]), 0.9).when(a["year"] == b["year"], 0.8).otherwise(0.5)
    gap = F.greatest(al - bh, bl - ah)
    return (
        F.when(a.isNull() | b.isNull() | a["year"].isNull() | b["year"].isNull(), 0.3)
        .when(exact(a) & exact(b) & (F.abs(a["year"] - b["year"]) <= 2), same)
        .when((ah < bl) | (bh < al), F.when(~(exact(a) & exact(b)) & (gap <= 8), 0.4).otherwise(0.0))
        .otherwise(F.when(exact(a) | exact(b), 0.7).otherwise(0.6))
    )


def format_date(d: Column) -> Column:
    """A parsed date as text."""
    start = F.concat_ws(" ", d["day"].cast("string"), month_name(d["month"]), d["year"].cast("string"))
    return F.when(d["qualifier"] == "BET", F.concat(F.lit("BET "), start, F.lit(" AND "), F.coalesce(d["year2"], d["year"]).cast("string"))).otherwise(F.concat_ws(" ", d["qualifier"], start))


def first_year(value: Column, digits: str = "4") -> Column:
    return F.regexp_extract(value, rf"\b(\d{{{digits}}})\b", 1).try_cast("int")


def event_years(value: Column) -> Column:
    """(least, greatest) four-digit year in a text."""
    years = F.transform(F.regexp_extract_all(value, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.struct(F.array_min(years).alias("low"), F.array_max(years).alias("high"))


def viewer_sort_key(value: Column) -> Column:
    """(year, month, day, adjust): zeros where nothing is known, BEF one before and AFT one after."""
    d = parse_date(value)
    zero = lambda c: F.coalesce(c, F.lit(0))
    adjust = F.when(F.upper(value).rlike("^BEF"), -1).when(F.upper(value).rlike("^AFT"), 1).otherwise(0)
    return F.struct(zero(d["year"]).alias("y"), zero(d["month"]).alias("m"), zero(d["day"]).alias("d"), F.when(d.isNull(), 0).otherwise(adjust).alias("adj"))


def marriage_dates_compatible(a: Column, b: Column) -> Column:
    """Missing or equal dates are; two bounds are not; a bound is with a year on its side; else equal years are."""
    ya, yb = first_year(a), first_year(b)
    bound = lambda v: F.upper(v).rlike("^(BEF|AFT) ")
    side = lambda v, y, other: F.when(F.upper(v).rlike("^BEF "), other < y).otherwise(other > y)
    none = lambda v: F.coalesce(v, F.lit("")) == ""
    return F.coalesce(F.when(none(a) | none(b) | (a == b), True).when(bound(a) & bound(b), False).when(bound(a), side(a, ya, yb)).when(bound(b), side(b, yb, ya)).otherwise(ya == yb), F.lit(False))


def death_age_class(age: Column) -> Column:
    """stillborn, infant (under a year), child (up to 12), or null."""
    v = F.upper(F.trim(age))
    years = F.regexp_extract(v, r"(\d+)Y", 1).try_cast("int")
    known = v.rlike(r"\d+[YMD]")
    return F.when(v == "STILLBORN", "stillborn").when(v == "INFANT", "infant").when(v == "CHILD", "child").when(known & (F.coalesce(years, F.lit(0)) < 1), "infant").when(known & (years <= 12), "child")


def age_at(low: Column, high: Column, birth: Column) -> Column:
    """An age, or a range of ages, as text."""
    return F.when(birth.isNull() | low.isNull(), None).when(low == high, (low - birth).cast("string")).otherwise(F.concat((low - birth).cast("string"), F.lit("–"), (high - birth).cast("string")))


def shown_date(value: Column) -> Column:
    """A date as people read it: ABT as c., BET a AND b as a–b, months in small letters."""
    v = F.regexp_replace(F.regexp_replace(F.trim(value), "^(ABT|CAL|EST) ", "c. "), "^BET (.+) AND (.+)$", "$1–$2")
    v = F.regexp_replace(F.regexp_replace(v, "^BEF ", "before "), "^AFT ", "after ")
    return reduce(lambda x, m: F.regexp_replace(x, rf"\b{m}\b", m.title()), MONTHS, v)
