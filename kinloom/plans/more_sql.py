"""SQL for the rewrites, scalar functions, graph views and linkage, in DuckDB's dialect."""

from __future__ import annotations

from functools import reduce

from kinloom.functions import dates, text
from kinloom.plans.check_sql import _Y4, PREFIX, _in, _place, classify
from kinloom.sources import lineage as L

_BOTH = "SELECT '-' AS sign, file_id, lineno, CAST(0 AS INT) AS seq, raw FROM x WHERE n IS DISTINCT FROM raw UNION ALL SELECT '+', file_id, lineno, 0, n FROM x WHERE n IS DISTINCT FROM raw AND n IS NOT NULL"


def _rewritten(test: str, value: str) -> str:
    return PREFIX + f", x AS (SELECT file_id, lineno, raw, CASE WHEN {test} THEN left(raw, length(raw) - length(value)) || {value} ELSE raw END AS n FROM l) {_BOTH}"


def _raw(new: str, more: str = "", source: str = "l") -> str:
    """new: the line as it comes out, null where it goes."""
    return PREFIX + f", x AS (SELECT file_id, lineno, raw, {new} AS n FROM {source}) {_BOTH} {more}"


def _upper_months(v: str) -> str:
    return reduce(lambda x, m: f"regexp_replace({x}, '(?i)\\b{m}\\b', '{m}', 'g')", dates.MONTHS, v)


def normalize_date(v: str) -> str:
    """The chain of rules; month words are matched without regard to accents' word edges."""
    mon = "list_extract([" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "], {})"
    v = f"trim({v})"

    def step(x: str, pattern: str, d: int, m: int, y: int) -> str:
        get = lambda k: f"TRY_CAST(NULLIF(regexp_extract({x}, '{pattern}', {k}), '') AS INT)"
        return f"CASE WHEN regexp_matches({x}, '{pattern}') AND {get(m)} BETWEEN 1 AND 12 THEN {get(d)} || ' ' || {mon.format(get(m))} || ' ' || regexp_extract({x}, '{pattern}', {y}) ELSE {x} END"

    v = step(v, r"^(\d{4})-(\d{2})-(\d{2})$", 3, 2, 1)
    v = f"CASE WHEN contains({v}, '/') THEN {step(v, r'^(\d{1,2})/(\d{1,2})/(\d{4})$', 2, 1, 3)} ELSE {v} END"
    v = f"regexp_replace({v}, '^\\s*(.+\\d{{4}})\\s*-\\s*(.+\\d{{4}})$', 'BET \\1 AND \\2')"
    for pattern, to in dates.RULES:
        v = f"regexp_replace({v}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    for short, words in dates.MONTH_WORDS.items():
        v = f"regexp_replace({v}, '(?i)\\b(?:{'|'.join(sorted(words, key=len, reverse=True))})\\b', '{short}', 'g')"
    return f"trim(regexp_replace({_upper_months(v)}, '\\s{{2,}}', ' ', 'g'))"


_MON = "|".join(dates.MONTHS)
_NICK = "regexp_extract(split_part(value, '/', 1), '\"([^\"]+)\"', 1)"
_ENDS = "SELECT file_id, rec_no, rx, max(lineno) AS lineno, min(lineno) AS head FROM l WHERE rec_tag = 'INDI' GROUP BY ALL"

FIX_SQL: dict[str, str] = {
    "date_caps": _rewritten(f"tag = 'DATE' AND {_upper_months('value')} <> value", _upper_months("trim(value)")),
    "normalize_dates": PREFIX + f", x AS (SELECT file_id, lineno, raw, CASE WHEN tag = 'DATE' AND level = 2 THEN left(raw, length(raw) - length(value)) || m.n ELSE raw END AS n FROM l LEFT JOIN (SELECT value AS v, {normalize_date('value')} AS n FROM (SELECT DISTINCT value FROM l WHERE tag = 'DATE')) m ON m.v = l.value) {_BOTH}",
    "dateless_dates": _rewritten(f"tag = 'DATE' AND regexp_matches(trim(value), '(?i)^\\d{{1,2}}\\s+({_MON})\\.?$')", "'(' || upper(regexp_replace(trim(value), '\\.$', '')) || ', year unknown)'"),
    "name_double_spaces": _rewritten("tag = 'NAME'", "trim(regexp_replace(value, '  +', ' ', 'g'))"),
    "plac": _rewritten("tag = 'PLAC' AND value <> ''", _place("value")),
    "curly_quotes": _rewritten("true", "translate(value, '" + "".join(text.QUOTES) + "', '" + "".join(text.QUOTES.values()).replace("'", "''") + "')"),
    "bare_at_signs": _rewritten("NOT regexp_matches(trim(value), '^@[^@]+@$') AND contains(value, '@') AND NOT contains(value, '@@')", "replace(value, '@', '@@')"),
    "blocked_occupations": _raw(f"CASE WHEN tag = 'OCCU' AND lower(trim(value)) IN ({_in(text.IGNORED_OCCUPATIONS)}) THEN NULL ELSE raw END"),
    "unknown_surname": _raw("CASE WHEN tag = 'SURN' AND upper(trim(value)) = 'UNKNOWN' THEN NULL WHEN tag = 'NAME' THEN regexp_replace(raw, '(?i)/UNKNOWN/', '//', 'g') ELSE raw END"),
    "physical_attributes": _raw("CASE WHEN tag = '_HEIG' THEN rtrim(level || ' DSCR Height: ' || value) WHEN tag = '_WEIG' THEN rtrim(level || ' DSCR Weight: ' || value) ELSE raw END"),
    "trailing_whitespace": _raw("CASE WHEN coalesce(n_tag, '') <> 'CONC' THEN rtrim(raw) ELSE raw END"),
    "conc_cont_levels": _raw("CASE WHEN tag IN ('CONC', 'CONT') AND level <> b + 1 THEN (b + 1) || regexp_replace(raw, '^\\s*\\d+', '') ELSE raw END", source="(SELECT *, last_value(CASE WHEN tag NOT IN ('CONC', 'CONT') THEN level END IGNORE NULLS) OVER (PARTITION BY file_id, rec_no ORDER BY lineno) AS b FROM l)"),
    "bare_events": _raw("CASE WHEN tag IN ('BIRT', 'CHR', 'DEAT') AND level = 1 AND trim(value) = '' AND coalesce(n_level, 0) < 2 THEN '1 ' || tag || ' Y' ELSE raw END"),
    "nicknames": _raw(f"CASE WHEN tag = 'NAME' AND {_NICK} <> '' THEN left(raw, length(raw) - length(value)) || trim(regexp_replace(regexp_replace(value, '\"[^\"]+\"', '', 'g'), '  +', ' ', 'g')) ELSE raw END", f"UNION ALL SELECT '+', file_id, lineno, 1, (level + 1) || ' NICK ' || {_NICK} FROM l WHERE tag = 'NAME' AND {_NICK} <> ''"),
    "nonstandard_events": _raw("CASE WHEN level = 1 AND tag IN ('_MILT', '_SEPR') THEN '1 EVEN' ELSE raw END", "UNION ALL SELECT '+', file_id, lineno, 1, CASE tag WHEN '_MILT' THEN '2 TYPE Military Service' ELSE '2 TYPE Separation' END FROM l WHERE level = 1 AND tag IN ('_MILT', '_SEPR')"),
    "presumed_deceased": PREFIX + f", b AS (SELECT file_id, rec_no FROM (SELECT *, {_Y4} AS y FROM ev WHERE rec_tag = 'INDI') GROUP BY file_id, rec_no HAVING min_by(y, l1_no) FILTER (tag = 'BIRT' AND y IS NOT NULL) <= 1906 AND NOT bool_or(tag = 'DEAT')) SELECT '+' AS sign, e.file_id, e.lineno, CAST(1 AS INT) AS seq, '1 DEAT Y' AS raw FROM ({_ENDS}) e JOIN b USING (file_id, rec_no)",
    "sole_alternate": PREFIX + "SELECT '-' AS sign, a.file_id, a.lineno, CAST(0 AS INT) AS seq, a.raw FROM k a JOIN (SELECT file_id, l1_no FROM (SELECT *, count(*) OVER (PARTITION BY file_id, rec_no, tag) AS n FROM ev WHERE rec_tag = 'INDI' AND tag IN ('BIRT', 'DEAT')) WHERE n = 1 AND lower(type) = 'alternate') b ON b.file_id = a.file_id AND b.l1_no = a.parent WHERE a.tag = 'TYPE' AND a.level = 2 AND lower(trim(a.value)) = 'alternate'",
    "addr_under_plac": _raw("CASE WHEN tag = 'ADDR' AND p_tag = 'PLAC' AND level = p_level + 1 THEN rtrim(p_level || ' ADDR ' || value) ELSE raw END"),
    "note_under_plac": _raw("CASE WHEN tag = 'NOTE' AND p_tag = 'PLAC' AND level = p_level + 1 THEN rtrim(p_level || ' ADDR ' || value) ELSE raw END"),
    "plac_addresses": _raw(f"CASE WHEN tag = 'PLAC' AND contains(value, ',') AND {classify('split_part(value, chr(44), 1)')} IN ('addr', 'note') THEN left(raw, length(raw) - length(value)) || trim(substr(value, length(split_part(value, ',', 1)) + 2)) ELSE raw END", f"UNION ALL SELECT '+', file_id, lineno, 1, rtrim((level + 1) || ' ' || upper({classify('split_part(value, chr(44), 1)')}) || ' ' || trim(split_part(value, ',', 1))) FROM l WHERE tag = 'PLAC' AND contains(value, ',') AND {classify('split_part(value, chr(44), 1)')} IN ('addr', 'note')"),
    "duplicate_names": PREFIX + ", d AS (SELECT file_id, rec_no, lineno, lead(lineno, 1, 999999999) OVER (PARTITION BY file_id, rec_no ORDER BY lineno) AS stop, row_number() OVER (PARTITION BY file_id, rec_no, tag, lower(trim(value)) ORDER BY lineno) AS nth, tag FROM l WHERE level = 1 AND rec_tag = 'INDI') SELECT '-' AS sign, l.file_id, l.lineno, CAST(0 AS INT) AS seq, l.raw FROM l JOIN d ON d.file_id = l.file_id AND d.rec_no = l.rec_no AND l.lineno >= d.lineno AND l.lineno < d.stop WHERE d.tag = 'NAME' AND d.nth > 1",
    "duplicate_resi": PREFIX + ", d AS (SELECT file_id, rec_no, l1_no FROM (SELECT *, row_number() OVER (PARTITION BY file_id, rec_no, date_raw, place ORDER BY l1_no) AS nth FROM ev WHERE tag = 'RESI' AND rec_tag = 'INDI') WHERE nth > 1) SELECT '-' AS sign, l.file_id, l.lineno, CAST(0 AS INT) AS seq, l.raw FROM l JOIN d USING (file_id, rec_no, l1_no)",
}

#: Dates of orders written in eight ways: text, what normalizing gives, qualifier, year, month, day, second year.
_VARIANTS = [
    ("d || ' ' || mon || ' ' || y", "d || ' ' || mon || ' ' || y", None, "m", "d", None), ("lower(mon) || ' ' || y", "mon || ' ' || y", None, "m", None, None), ("'about ' || y", "'ABT ' || y", "ABT", None, None, None),
    ("'before ' || d || ' ' || mon || ' ' || y", "'BEF ' || d || ' ' || mon || ' ' || y", "BEF", "m", "d", None), ("'between ' || y || ' and ' || (y + 2)", "'BET ' || y || ' AND ' || (y + 2)", "BET", None, None, "y + 2"),
    ("y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0')", "d || ' ' || mon || ' ' || y", None, "m", "d", None), ("'aft. ' || y", "'AFT ' || y", "AFT", None, None, None), ("mon || ' ' || d || ', ' || y", "d || ' ' || mon || ' ' || y", None, "m", "d", None),
]


def date_texts(spark: bool) -> str:
    s = "string" if spark else "varchar"
    mon = f"split_part('{'|'.join(dates.MONTHS)}', '|', cast(mn as int))"
    cell = lambda x: x.replace("(y + 2)", f"cast(yn + 2 as {s})")
    texts = " ".join(f"WHEN {k} THEN {cell(v[0])}" for k, v in enumerate(_VARIANTS))
    base = f"SELECT o_orderkey AS id, v, yn, mn, dn, cast(yn as {s}) AS y, cast(mn as {s}) AS m, cast(dn as {s}) AS d, {mon} AS mon FROM (SELECT o_orderkey, o_orderkey % 8 AS v, cast(year(o_orderdate) as int) - 200 AS yn, cast(month(o_orderdate) as int) AS mn, cast(day(o_orderdate) as int) AS dn FROM orders) o"
    return f"SELECT *, CASE v {texts} END AS written FROM ({base}) b"


def _known(k: int, none: str = "NULL") -> str:
    cases = " ".join(f"WHEN {n} THEN {v[k]}" for n, v in enumerate(_VARIANTS) if v[k])
    return f"CASE v {cases.replace('THEN m', 'THEN mn').replace('THEN d', 'THEN dn').replace('y + 2', 'yn + 2')} ELSE {none} END"


_NORMAL = "CASE v " + " ".join(f"WHEN {k} THEN {v[1].replace('(y + 2)', 'cast(yn + 2 as varchar)')}" for k, v in enumerate(_VARIANTS)) + " END"
_QUAL = "CASE v WHEN 2 THEN 'ABT' WHEN 3 THEN 'BEF' WHEN 4 THEN 'BET' WHEN 6 THEN 'AFT' END"
DATES_SQL = f"""SELECT id, written, {_NORMAL} AS normal, coalesce({_QUAL}, '') AS qualifier, yn AS year, CAST({_known(3)} AS INT) AS month, CAST({_known(4)} AS INT) AS day, CAST({_known(5)} AS INT) AS year2,
  CAST(CASE v WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 6 THEN 1 ELSE 8 END + 1 + CASE WHEN {_known(3)} IS NULL THEN 0 ELSE 2 END + CASE WHEN {_known(4)} IS NULL THEN 0 ELSE 4 END AS INT) AS specificity FROM ({date_texts(False)})"""

#: Families by arithmetic on customer keys: child k of father 2k + 1 and mother 2k + 2.
PARENTS = "SELECT c_custkey AS child, 2 * c_custkey + 1 AS father, 2 * c_custkey + 2 AS mother FROM customer WHERE 2 * c_custkey + 2 < (SELECT count(*) FROM customer)"
UPWARD = "SELECT c_custkey AS child, CASE WHEN c_custkey % 20 = 9 THEN c_custkey - 9 WHEN c_custkey % 20 < 9 THEN c_custkey + 1 WHEN c_custkey % 20 < 19 THEN c_custkey + 1 END AS parent FROM customer"

GRAPH_SQL = {
    "graph_ancestors": f"WITH RECURSIVE p AS ({PARENTS}), up AS (SELECT CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS indi UNION ALL SELECT up.k * 2 + s.side, CASE WHEN s.side = 0 THEN p.father ELSE p.mother END FROM up JOIN p ON p.child = up.indi, (SELECT unnest([0, 1]) AS side) s) SELECT k, indi FROM up",
    "graph_cycles": f"WITH RECURSIVE p AS ({UPWARD}), r AS (SELECT child AS a, parent AS b FROM p WHERE parent IS NOT NULL UNION SELECT r.a, p.parent FROM r JOIN p ON p.child = r.b WHERE p.parent IS NOT NULL) SELECT a AS node FROM r WHERE a = b",
    "graph_trees": "SELECT min(k) AS component, count(*) AS size FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 100 < 60 THEN c_custkey - c_custkey % 20 ELSE c_custkey END AS t FROM customer) GROUP BY t",
    "graph_siblings": PREFIX + "SELECT DISTINCT a.file_id, a.indi, b.indi AS sibling FROM edge a JOIN edge b ON b.file_id = a.file_id AND b.fam = a.fam AND b.indi <> a.indi WHERE a.role = 'CHIL' AND b.role = 'CHIL'",
    "graph_spouses": PREFIX + "SELECT DISTINCT a.file_id, a.indi, a.fam, b.indi AS spouse FROM edge a JOIN edge b ON b.file_id = a.file_id AND b.fam = a.fam AND b.role <> a.role WHERE a.role <> 'CHIL' AND b.role <> 'CHIL'",
    "graph_parents": PREFIX + "SELECT c.file_id, c.indi AS child, (SELECT max(e.indi) FROM edge e WHERE e.file_id = c.file_id AND e.fam = c.fam AND e.role = 'HUSB') AS father, (SELECT max(e.indi) FROM edge e WHERE e.file_id = c.file_id AND e.fam = c.fam AND e.role = 'WIFE') AS mother FROM (SELECT file_id, indi, min_by(fam, ord) AS fam FROM edge WHERE role = 'CHIL' GROUP BY ALL) c WHERE EXISTS (SELECT 1 FROM edge e WHERE e.file_id = c.file_id AND e.fam = c.fam AND e.role <> 'CHIL')",
    "graph_half_siblings": "WITH e AS (SELECT c_custkey AS kid, c_custkey // 4 AS fam, (c_custkey // 4) // 3 AS p FROM customer) SELECT DISTINCT 'x' AS file_id, a.kid AS indi, a.p AS shared_parent, b.kid AS half FROM e a JOIN e b ON a.p = b.p AND a.fam <> b.fam",
    "graph_timeline": PREFIX + ", r AS (SELECT u.file_id, u.indi AS p, c.indi AS c FROM edge u JOIN edge c ON c.file_id = u.file_id AND c.fam = u.fam AND c.role = 'CHIL' WHERE u.role <> 'CHIL'), s AS (SELECT DISTINCT a.file_id, a.indi, b.indi AS spouse FROM edge a JOIN edge b ON b.file_id = a.file_id AND b.fam = a.fam AND b.role <> a.role WHERE a.role <> 'CHIL' AND b.role <> 'CHIL'), t AS (SELECT r.file_id, r.p AS indi, v.birth AS year, 'child_birth' AS kind, r.c AS relative FROM r JOIN vit v ON v.file_id = r.file_id AND v.xref = r.c UNION SELECT r.file_id, r.p, v.death, 'child_death', r.c FROM r JOIN vit v ON v.file_id = r.file_id AND v.xref = r.c UNION SELECT r.file_id, r.c, v.death, 'parent_death', r.p FROM r JOIN vit v ON v.file_id = r.file_id AND v.xref = r.p UNION SELECT s.file_id, s.indi, v.death, 'spouse_death', s.spouse FROM s JOIN vit v ON v.file_id = s.file_id AND v.xref = s.spouse) SELECT t.*, CASE WHEN t.year <= m.birth + 18 THEN 'Early' WHEN t.year >= coalesce(m.death, m.birth + 100) THEN 'Later' ELSE 'Life' END AS section FROM t JOIN vit m ON m.file_id = t.file_id AND m.xref = t.indi WHERE t.year BETWEEN m.birth AND coalesce(m.death, m.birth + 100)",
    "collapse_runs": "SELECT user_id, island, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL",
    "subsumed_ranges": "WITH r AS (SELECT o_custkey AS place, o_orderkey AS id, o_orderkey % 50 AS low, o_orderkey % 50 + o_orderkey % 17 AS high FROM orders) SELECT DISTINCT a.place, a.id, a.low, a.high FROM r a JOIN r b ON b.place = a.place AND b.low <= a.low AND b.high >= a.high AND (b.low < a.low OR b.high > a.high)",
    "primary_families": "SELECT person, fam FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY CASE WHEN wf AND nf = 1 THEN 0 WHEN ol AND nl = 1 THEN 1 ELSE 2 END, coalesce(married, 99999), number) AS n FROM (SELECT o_custkey AS person, o_orderkey AS fam, o_orderkey % 5 = 0 AS wf, o_orderkey % 3 = 0 AS ol, CASE WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate) END AS married, o_orderkey AS number, count(*) FILTER (o_orderkey % 5 = 0) OVER (PARTITION BY o_custkey) AS nf, count(*) FILTER (o_orderkey % 3 = 0) OVER (PARTITION BY o_custkey) AS nl FROM orders)) WHERE n = 1",
    "fold_lines": PREFIX + ", n AS (SELECT *, last_value(CASE WHEN tag NOT IN ('CONT', 'CONC') THEN lineno END IGNORE NULLS) OVER (PARTITION BY file_id, rec_no ORDER BY lineno) AS a FROM l WHERE level IS NOT NULL) SELECT file_id, a AS lineno, string_agg(CASE WHEN tag = 'CONT' THEN chr(10) ELSE '' END || value, '' ORDER BY lineno) AS value FROM n GROUP BY file_id, a",
    "parse_lines": PREFIX + "SELECT l.file_id, l.lineno, l.level, l.tag, l.value, CAST(l.rec_no AS BIGINT) AS rec_no, l.rx AS rec_xref, l.rec_tag, l.l1_no, up.parent AS parent_lineno FROM l LEFT JOIN up USING (file_id, lineno)",
    "people": PREFIX + "SELECT file_id, rx AS xref, upper(trim(max_by(value, lineno) FILTER (tag = 'SEX'))) AS sex, count(*) FILTER (tag = 'NAME') AS names, coalesce(string_agg(trim(value), ',' ORDER BY lineno) FILTER (tag = 'FAMS'), '') AS fams, coalesce(string_agg(trim(value), ',' ORDER BY lineno) FILTER (tag = 'FAMC'), '') AS famc FROM l WHERE rec_tag = 'INDI' AND level <= 1 GROUP BY file_id, rec_no, rx",
    "events": PREFIX + "SELECT file_id, rx AS owner, tag, CAST(l1_no AS BIGINT) AS l1_no, date_raw, place, row_number() OVER (PARTITION BY file_id, rec_no, tag ORDER BY l1_no) - 1 AS nth FROM ev",
    "citations": PREFIX + "SELECT file_id, lineno, rx AS owner, source, page FROM cit",
    "source_titles": PREFIX + "SELECT file_id, rx AS xref, max_by(trim(value), lineno) FILTER (tag = 'TITL') AS title, max_by(trim(value), lineno) FILTER (tag = 'AUTH') AS author FROM l WHERE rec_tag = 'SOUR' AND level <= 1 GROUP BY file_id, rec_no, rx",
    "all_places": PREFIX + "SELECT DISTINCT place FROM ev WHERE place <> ''",
    "places": f"SELECT n_nationkey AS id, {_place('raw')} AS normal, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ', ' || r_name WHEN n_nationkey % 3 = 1 THEN n_name || ', ' || r_name ELSE n_name END AS shown, {classify(chr(110) + '_name')} AS kind FROM (SELECT n_nationkey, n_name, r_name, CASE n_nationkey % 3 WHEN 0 THEN ' ' || n_name || ' ,' || r_name || ',' WHEN 1 THEN n_name || ',x,  ' || r_name ELSE ',' || n_name END AS raw FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "place_pairs": "WITH n AS (SELECT DISTINCT lower(n_name) AS a FROM nation) SELECT x.a AS key_a, y.a AS key_b FROM n x JOIN n y ON x.a = y.a OR (length(x.a) >= 5 AND length(y.a) >= 5 AND levenshtein(x.a, y.a) <= 2)",
    "close_words": "WITH w AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark)), k AS (SELECT w FROM w WHERE w <> '') SELECT x.w AS key_a, y.w AS key_b FROM k x JOIN k y ON x.w = y.w OR (length(x.w) >= 5 AND length(y.w) >= 5 AND levenshtein(x.w, y.w) <= 2)",
    "search_people": "SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '00001') OR (starts_with(lower(split_part(c_name, '#', 2)), '000001'))",
    "id_map": "SELECT c_custkey AS xref_b, CASE WHEN c_custkey % 3 = 0 THEN '@I' || c_custkey || '@' ELSE format('@I_MERGE_{:04d}@', row_number() OVER (PARTITION BY c_custkey % 3 = 0 ORDER BY c_custkey)) END AS xref_a FROM customer",
    "match_families": "WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 6 = 0) SELECT k AS xref_b, k AS xref_a, CASE WHEN k % 18 = 0 THEN 1 WHEN k % 18 = 6 THEN 2 ELSE 3 END AS rule FROM a",
    "merge_unique": "SELECT owner, min_by(side, side * 1000000000 + ord) AS side, note FROM (SELECT c_nationkey AS owner, 0 AS side, c_custkey AS ord, c_mktsegment AS note FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_nationkey, 1, c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1) GROUP BY owner, note",
    "merge_dates": "SELECT id, CASE WHEN sb > sa THEN 'b' ELSE 'a' END AS side FROM (SELECT o_orderkey AS id, list_extract([15, 11, 3, 8, 1, 15, 2, 15], CAST(o_orderkey % 8 + 1 AS INT)) AS sa, list_extract([15, 11, 3, 8, 1, 15, 2, 15], CAST((o_orderkey + 3) % 8 + 1 AS INT)) AS sb FROM orders)",
    "nonstandard_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "occupations": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Tailor ' || doc_id END AS occupation FROM documents",
    "place_similarity": "SELECT x.n_nationkey AS a, y.n_nationkey AS b, CASE WHEN x.n_nationkey = y.n_nationkey THEN 1.0 WHEN x.n_regionkey = y.n_regionkey THEN 1.0 / 3 ELSE 0.0 END AS score FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey",
    "long_documents": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 255 GROUP BY doc_id",
    "tag_strip": "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages",
}


def _parsed(v: str) -> tuple[str, str, str, str]:
    """Qualifier, year, month and day of a date text."""
    u = f"upper(trim({v}))"
    span = r"^(?:BET(?:WEEN)?\s+(.+?)\s+AND|FROM\s+(.+?)\s+TO)\s+(.+)$"
    simple = r"^(?:(?:(\d{1,2})\s+)?([A-Z]{3})\s+)?(\d{3,4})$"
    first = f"trim(CASE WHEN regexp_matches({u}, '{span}') THEN regexp_extract({u}, '{span}', 1) || regexp_extract({u}, '{span}', 2) ELSE regexp_replace({u}, '^(FROM|ABT|ABOUT|CAL|EST|BEF|AFT)\\.?\\s+', '') END)"
    part = lambda k: f"NULLIF(regexp_extract({first}, '{simple}', {k}), '')"
    month = "list_position([" + ", ".join(f"'{m}'" for m in dates.MONTHS) + f"], {part(2)})"
    return u, f"TRY_CAST({part(3)} AS INT)", f"NULLIF({month}, 0)", f"TRY_CAST({part(1)} AS INT)"


def _unsorted() -> str:
    _, y, m, d = _parsed("coalesce(date_raw, '')")
    known = lambda x: f"CASE WHEN {y} IS NULL THEN 0 ELSE coalesce({x}, 0) END"
    group = "CASE WHEN tag IN ('BIRT', 'CHR', 'BAPM', 'ADOP') THEN 0 WHEN tag IN ('DEAT', 'BURI', 'PROB', 'WILL') THEN 2 ELSE 1 END"
    key = f"[{group}, coalesce({y}, 9999), {known(m)}, {known(d)}]"
    return PREFIX + f", e AS (SELECT *, {key} AS key FROM ev), o AS (SELECT *, lag(key) OVER (PARTITION BY file_id, rec_no ORDER BY l1_no) AS prev FROM e) SELECT file_id, min(l1_no) AS lineno, rx AS xref, CAST(count(*) AS VARCHAR) AS detail FROM o WHERE key < prev GROUP BY file_id, rec_no, rx"


UNSORTED_SQL = _unsorted()
_SUB = "SELECT '-' AS sign, l.file_id, l.lineno, CAST(0 AS INT) AS seq, l.raw FROM l JOIN r ON r.file_id = l.file_id AND l.lineno >= r.lineno WHERE l.lineno < coalesce((SELECT min(x.lineno) FROM l x WHERE x.file_id = r.file_id AND x.lineno > r.lineno AND x.level <= r.level), 999999999)"
#: Blocks that go: r names their first lines.
FIX_SQL |= {
    "strip_vendor": PREFIX + f", r AS (SELECT * FROM l WHERE tag IN ({_in('_APID _OID _TID _PID _LKID _MSER _CREA _USER _ORIG _ENCR _ATL _CLON _DATE _PRIM _CROP _LEFT _TOP _WDTH _HGHT _TYPE _WPID _HPID _MTYPE _STYPE _SIZE _DSCR _META _TREE _ENV _MTTAG'.split())})) {_SUB}",
    "duplicate_citations": PREFIX + f", r AS (SELECT l.* FROM l JOIN (SELECT file_id, lineno FROM (SELECT *, row_number() OVER (PARTITION BY file_id, l1_no, source, children ORDER BY lineno) AS nth FROM cit WHERE l1_no IS NOT NULL AND level > 1) WHERE nth > 1) USING (file_id, lineno)) {_SUB}",
    "same_source_citations": PREFIX + f", r AS (SELECT l.* FROM l JOIN (SELECT file_id, lineno FROM (SELECT *, row_number() OVER (PARTITION BY file_id, l1_no, source ORDER BY lineno) AS nth FROM cit WHERE l1_no IS NOT NULL AND level > 1) WHERE nth > 1) USING (file_id, lineno)) {_SUB}",
    "dangling_pointers": PREFIX + f", r AS (SELECT p.* FROM ptr p WHERE p.tag IN ('HUSB', 'WIFE', 'CHIL', 'FAMS', 'FAMC', 'OBJE', 'SOUR', 'REPO') AND NOT EXISTS (SELECT 1 FROM def d WHERE d.file_id = p.file_id AND d.target = p.target AND d.target_tag = CASE WHEN p.tag IN ('HUSB', 'WIFE', 'CHIL') THEN 'INDI' WHEN p.tag IN ('FAMS', 'FAMC') THEN 'FAM' ELSE p.tag END)) {_SUB}",
    "redundant_pages": PREFIX + f", r AS (SELECT k.file_id, k.lineno, k.level FROM k JOIN cit c ON c.file_id = k.file_id AND c.lineno = k.parent JOIN l t ON t.file_id = c.file_id AND t.rx = c.source AND t.rec_tag = 'SOUR' AND t.level = 1 AND t.tag = 'TITL' WHERE k.tag = 'PAGE' AND t.value <> '' AND regexp_replace(lower(trim(c.page)), 's$', '') = regexp_replace(lower(trim(t.value)), 's$', '')) {_SUB}",
    "bapm_births": PREFIX + f", b AS (SELECT file_id, rx, min_by(y, l1_no) FILTER (tag IN ('BAPM', 'CHR') AND y IS NOT NULL) AS y FROM (SELECT *, {_Y4} AS y FROM ev WHERE rec_tag = 'INDI') GROUP BY file_id, rec_no, rx HAVING count(*) FILTER (tag IN ('BAPM', 'CHR') AND y IS NOT NULL) > 0 AND NOT bool_or(tag = 'BIRT' AND date_raw IS NOT NULL)), t AS (SELECT b.*, min(l.lineno) AS head, max(l.lineno) FILTER (l.level = 1 AND l.tag = 'BIRT') AS birt FROM b JOIN l ON l.file_id = b.file_id AND l.rx = b.rx AND l.rec_tag = 'INDI' GROUP BY ALL) SELECT '+' AS sign, file_id, head AS lineno, CAST(1 AS INT) AS seq, '1 BIRT' AS raw FROM t WHERE birt IS NULL UNION ALL SELECT '+', file_id, coalesce(birt, head), 2, '2 DATE EST ' || y FROM t",
    "note_under_addr": _raw("CASE WHEN tag = 'ADDR' AND n_tag = 'NOTE' AND n_level = level + 1 THEN rtrim(level || ' ADDR ' || n_value) WHEN tag = 'NOTE' AND p_tag = 'ADDR' AND level = p_level + 1 THEN rtrim(level || ' CONT ' || p_value) ELSE raw END", source="(SELECT *, lead(value) OVER (PARTITION BY file_id ORDER BY lineno) AS n_value, lag(value) OVER (PARTITION BY file_id ORDER BY lineno) AS p_value FROM l)"),
    "record_order": PREFIX + ", o AS (SELECT file_id, raw, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(list_position(['HEAD', 'SUBM', 'INDI', 'FAM', 'SOUR', 'REPO', 'OBJE', 'NOTE', '-', 'TRLR'], rec_tag) - 1, 8), rec_no, lineno) AS place FROM l), x AS (SELECT a.file_id, a.lineno, a.raw, o.raw AS n FROM (SELECT file_id, lineno, raw, row_number() OVER (PARTITION BY file_id ORDER BY lineno) AS place FROM l) a JOIN o USING (file_id, place)) " + _BOTH,
}
