"""Names, places, titles and markup as column expressions, and the few functions that need Python."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format's tools: word lists and replacement tables.
PARTICLES = (
    "af aus bin binte da dal dalla das de degli dei del della delle dello den der des di do dos du la las le les lo los van von y z ze zu zur"
).split()
STREET_WORDS = (
    "Avenue|Ave|Boulevard|Blvd|Road|Rd|Street|Lane|Ln|Drive|Dr|Way|Court|Ct|Place|Pl|Terrace|Ter|Circle|Cir|Highway|Hwy|Route|Rte|Alley|Aly|Parkway|Pkwy"
)
VENUE_WORDS = (
    "Cemetery|Cemetary|Graveyard|Churchyard|Church|Chapel|Cathedral|Hospital|Clinic|Sanitarium|Sanatorium|School|University|Synagogue|Mosque|Temple|"
    "Crematorium|Crematory|Mortuary|Funeral|Convent|Monastery|Asylum|Prison|Jail|Workhouse|Poorhouse|Infirmary|Barracks|Camp|Plantation"
)
COUNTRY_ALIASES = {
    "usa": "united states", "u.s.a.": "united states", "united states of america": "united states",
    "england": "united kingdom", "great britain": "united kingdom", "scotland": "united kingdom", "wales": "united kingdom",
}
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "‹": "'", "›": "'", "«": '"', "»": '"'}
IGNORED_OCCUPATIONS = (
    "home duties", "unpaid domestic duties", "student", "school", "scholar", "private means", "none", "(no occupation)", "keeping house",
    "house wife", "housewife", "homemaker", "retired", "étudiant", "étudiante", "enfant",
)
UNKNOWN_NAMES = ("unknown", "unkn", "unk", "unnamed", "name unknown", "?", "nn", "n.n.")
#: Letters whose decomposition leaves no plain letter.
PLAIN = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i"}

ENTITY = r"&(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);"
MARKUP = r"<[^>]+>"


def _plain(s: str | None) -> str | None:
    if s is None or s.isascii():
        return s
    s = "".join(PLAIN.get(c, c) for c in s)
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


@F.pandas_udf(T.StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(_plain)


def _title(s: str | None) -> str | None:
    if s is None:
        return None
    words = re.split(r"(\s+)", s.title())
    return "".join(w.lower() if k and w.strip("/").lower() in PARTICLES else w for k, w in enumerate(words))


@F.pandas_udf(T.StringType())
def title_name(s: pd.Series) -> pd.Series:
    """Capitals at the start of words but for particles, of which the first word may be none."""
    return s.map(_title)


def _decode(s: str | None) -> str | None:
    if s is None:
        return None
    s = html.unescape(html.unescape(s)).replace(" ", " ")

    def link(m: re.Match) -> str:
        url, text = m.group(1).strip(), m.group(2).strip()
        if "##" in url or not url:
            return text
        return f"{text} ({url})" if text not in ("", url) else url

    s = re.sub(r'(?is)<a\s[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', link, s)
    s = re.sub(MARKUP, "", re.sub(r"(?i)<(?:p|br|li|/p|/li)[^>]*>", " ", s))
    return re.sub("  +", " ", s).strip()


@F.pandas_udf(T.StringType())
def decode_html(s: pd.Series) -> pd.Series:
    return s.map(_decode)


def _indel(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), with the LCS by bit-parallel dynamic programming."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & places.get(c, 0)
        row = (row + u | row - u) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_indel(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def rounded4(x: pd.Series) -> pd.Series:
    """Rounded to 4 places as binary numbers are, which Spark's round does not do."""
    return x.map(lambda v: round(v, 4))


def wrapped(value: str, limit: int) -> list[str]:
    """value in parts of at most limit characters, none but the last ending in a blank if that can be helped."""
    parts = []
    while len(value) > limit:
        cut = limit
        while cut > 1 and value[cut - 1] == " ":
            cut -= 1
        parts.append(value[:cut])
        value = value[cut:]
    return [*parts, value]


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap_value(value: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([wrapped(v or "", int(n)) for v, n in zip(value, limit)])


def normal(s: Column) -> Column:
    """Lower case without diacritics, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(strip_diacritics(s)), r"\s+", " "))


def name_parts(full: Column) -> Column:
    """(given, surname) of a NAME value: the surname stands between slashes."""
    surname = F.regexp_extract(full, r"/([^/]*)/", 1)
    given = F.when(full.contains("/"), F.regexp_replace(full, r"/[^/]*/", " ")).otherwise(full)
    return F.struct(F.trim(F.regexp_replace(F.regexp_replace(given, "/", " "), r"\s+", " ")).alias("given"), F.trim(surname).alias("surname"))


def parenthetical_surnames(full: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(full, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def strip_parentheticals(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", " "), r"\s+", " "))


def title_tokens(title: Column) -> Column:
    """The distinct words of a title that are longer than a letter, sorted."""
    words = F.split(F.regexp_replace(F.lower(strip_diacritics(F.coalesce(title, F.lit("")))), r"[!-/:-@\[-`{-~\s]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.char_length(w) > 1)))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def remove_accents(value: Column) -> Column:
    """Umlauts as two letters, then all other diacritics removed."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return strip_diacritics(value)


def straight_quotes(value: Column) -> Column:
    return F.translate(value, "".join(QUOTES), "".join(QUOTES.values()))


def normalize_place(value: Column) -> Column:
    v = F.trim(F.regexp_replace(F.trim(value), r"^,+|,+$", ""))
    return F.regexp_replace(F.regexp_replace(v, r"\s*,\s*", ", "), r"\s{2,}", " ")


def place_parts(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != "")


def classify_place_part(part: Column) -> Column:
    """addr, note or ambiguous; null for an empty part."""
    p = F.trim(part)
    bare = F.regexp_replace(p, r"^[A-Za-z]{1,3}\.\s+", "")
    return F.when(p == "", None).when(p.rlike(r"^\d") | bare.rlike(rf"(?i)\b({STREET_WORDS})\b"), "addr").when(p.rlike(rf"(?i)\b({VENUE_WORDS})\b"), "note").otherwise("ambiguous")


def compared_place(value: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(value)), r",+$", "")


def place_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of comma parts, 0.2 more if the first are equal, 1 at most."""
    return compared_places(compared_place(F.coalesce(a, F.lit(""))), compared_place(F.coalesce(b, F.lit(""))))


def compared_places(x: Column, y: Column) -> Column:
    """``place_similarity`` of what ``compared_place`` gives."""
    px, py = place_parts(x), place_parts(y)
    shared = jaccard(F.array_distinct(px), F.array_distinct(py)) + F.when(F.get(px, F.lit(0)) == F.get(py, F.lit(0)), 0.2).otherwise(0.0)
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.least(shared, F.lit(1.0)))


def shown_place(value: Column) -> Column:
    """City and state in the USA, else the first and the last part."""
    p = place_parts(value)
    last = F.element_at(p, -1)
    usa = F.lower(last).isin("usa", "united states", "united states of america")
    return F.when(F.size(p) == 0, "").when(F.size(p) == 1, last).when(usa & (F.size(p) > 2), F.concat_ws(", ", F.get(p, F.lit(0)), F.element_at(p, -2))).otherwise(F.concat_ws(", ", F.get(p, F.lit(0)), last))


def occupation(note: Column) -> Column:
    """The occupation that a note names, or null where it is none."""
    found = F.trim(F.regexp_extract(note, r"(?i)Occupation:\s*([^;]+)", 1))
    return F.when((found != "") & ~F.lower(found).isin(*IGNORED_OCCUPATIONS) & ~F.lower(found).startswith("unpaid domestic duties"), found)


def wrap_surname(name: Column) -> Column:
    """Slashes around the last word of a name that has none."""
    return F.when(name.contains("/"), name).otherwise(F.regexp_replace(F.trim(name), r"^(?:(.*) )?(\S+)$", "$1 /$2/"))


def matches_search(name: Column, query: Column) -> Column:
    """The search box: the query within the name; or each word of it the start of a word of the name, the last
    of the last word."""
    n, q = F.lower(F.replace(name, F.lit("/"), F.lit(""))), F.lower(F.trim(query))
    words, asked = F.split(n, r"\s+"), F.split(q, r"\s+")
    return n.contains(q) | ((F.size(asked) > 1) & F.element_at(words, -1).startswith(F.element_at(asked, -1)) & F.forall(asked, lambda a: F.exists(words, lambda w: w.startswith(a))))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def linkify(s: Column) -> Column:
    return F.regexp_replace(s, r"(https?://[^\s<>\"]+[^\s<>\".,;:)])", '<a href="$1">$1</a>')


def notexml_lines(s: Column) -> Column:
    """The lines of a <notexml> note, raw or escaped."""
    raw = F.replace(F.replace(F.replace(s, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.transform(F.regexp_extract_all(raw, F.lit(r"(?s)<line>(.*?)</line>"), F.lit(1)), lambda x: F.trim(x))


def json_for_script(value: Column) -> Column:
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))


def base62(n: int) -> str:
    digits, out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ""
    while True:
        n, r = divmod(n, 62)
        out = digits[r] + out
        if not n:
            return out


def base62_column(n: Column) -> Column:
    """base62 of a long, eleven digits at most."""
    digits = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    all_ = F.array_join(F.transform(F.sequence(F.lit(10), F.lit(0), F.lit(-1)), lambda k: F.substring(digits, (F.floor(n / F.pow(F.lit(62), k)) % 62 + 1).cast("int"), F.lit(1))), "")
    return F.regexp_replace(all_, "^0+(?=.)", "")
