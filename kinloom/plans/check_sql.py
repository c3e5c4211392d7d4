"""The same rules in DuckDB's SQL, over lines rebuilt from the customer table."""

from __future__ import annotations

from kinloom.functions import dates, text
from kinloom.operators import checks as C
from kinloom.sources import lineage as L
from kinloom.sources.synthetic import duckdb_sql

_G = L.GRAMMAR.replace("'", "''")
PREFIX = f"""
WITH raw_lines AS ({duckdb_sql()}),
p AS (SELECT file_id, lineno, raw, TRY_CAST(NULLIF(regexp_extract(raw, '{_G}', 1), '') AS INT) AS level, NULLIF(regexp_extract(raw, '{_G}', 2), '') AS xref,
  regexp_extract(raw, '{_G}', 3) AS tag, regexp_extract(raw, '{_G}', 4) AS value FROM raw_lines),
q AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY lineno) AS rec_no FROM p),
l AS (SELECT *, coalesce(first_value(xref) OVER r, '') AS rx, first_value(tag) OVER r AS rec_tag, last_value(CASE WHEN level = 1 THEN lineno END IGNORE NULLS) OVER r AS l1_no,
  lag(level) OVER f AS p_level, lag(tag) OVER f AS p_tag, lead(level) OVER f AS n_level, lead(tag) OVER f AS n_tag FROM q
  WINDOW f AS (PARTITION BY file_id ORDER BY lineno), r AS (PARTITION BY file_id, rec_no ORDER BY lineno)),
up AS (SELECT a.file_id, a.lineno, max(b.lineno) AS parent FROM l a JOIN l b ON a.file_id = b.file_id AND a.rec_no = b.rec_no AND b.lineno < a.lineno AND b.level < a.level GROUP BY ALL),
k AS (SELECT l.*, up.parent, o.tag AS parent_tag, o.level AS parent_level, o.value AS parent_value FROM l LEFT JOIN up USING (file_id, lineno) LEFT JOIN l o ON o.file_id = l.file_id AND o.lineno = up.parent),
ev AS (SELECT a.file_id, a.rec_no, a.rx, a.rec_tag, a.lineno AS l1_no, a.tag, trim(a.value) AS value,
  (SELECT min_by(trim(b.value), b.lineno) FROM l b WHERE b.file_id = a.file_id AND b.rec_no = a.rec_no AND b.l1_no = a.lineno AND b.level = 2 AND b.tag = 'DATE') AS date_raw,
  (SELECT min_by(trim(b.value), b.lineno) FROM l b WHERE b.file_id = a.file_id AND b.rec_no = a.rec_no AND b.l1_no = a.lineno AND b.level = 2 AND b.tag = 'PLAC') AS place,
  (SELECT min_by(trim(b.value), b.lineno) FROM l b WHERE b.file_id = a.file_id AND b.rec_no = a.rec_no AND b.l1_no = a.lineno AND b.level = 2 AND b.tag = 'TYPE') AS type
  FROM l a WHERE a.level = 1 AND a.rec_tag IN ('INDI', 'FAM') AND a.tag IN ({', '.join(f"'{t}'" for t in L.EVENT_TAGS)})),
cit AS (SELECT a.file_id, a.rec_no, a.rx, a.rec_tag, a.l1_no, a.lineno, a.level, trim(a.value) AS source, max_by(trim(b.value), b.lineno) FILTER (b.tag = 'PAGE') AS page,
  coalesce(string_agg(b.tag || ' ' || b.value, chr(10) ORDER BY b.lineno) FILTER (b.tag IS NOT NULL), '') AS children
  FROM l a LEFT JOIN k b ON b.file_id = a.file_id AND b.parent = a.lineno WHERE a.tag = 'SOUR' AND a.level > 0 AND regexp_matches(trim(a.value), '^@[^@]+@$') GROUP BY ALL),
ptr AS (SELECT *, trim(value) AS target FROM l WHERE level > 0 AND regexp_matches(trim(value), '^@[^@]+@$')),
def AS (SELECT file_id, xref AS target, min_by(tag, lineno) AS target_tag FROM l WHERE level = 0 AND xref IS NOT NULL GROUP BY ALL),
edge AS (SELECT file_id, rx AS fam, tag AS role, target AS indi, lineno AS ord FROM ptr WHERE rec_tag = 'FAM' AND level = 1 AND tag IN ('HUSB', 'WIFE', 'CHIL')),
fam AS (SELECT * FROM (SELECT file_id, rec_no AS ord, rx AS xref, max_by(trim(value), lineno) FILTER (tag = 'HUSB') AS husb, max_by(trim(value), lineno) FILTER (tag = 'WIFE') AS wife FROM l WHERE rec_tag = 'FAM' AND level <= 1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY file_id, xref ORDER BY ord DESC) = 1),
vit AS (SELECT i.file_id, i.rx AS xref, upper(trim(max_by(i.value, i.lineno) FILTER (i.tag = 'SEX'))) AS sex,
  (SELECT min_by(CAST(regexp_extract(e.date_raw, '\\b(\\d{{3,4}})\\b', 1) AS INT), e.l1_no) FROM ev e WHERE e.file_id = i.file_id AND e.rx = i.rx AND e.rec_tag = 'INDI' AND e.tag = 'BIRT' AND regexp_matches(e.date_raw, '\\b\\d{{3,4}}\\b')) AS birth,
  (SELECT min_by(CAST(regexp_extract(e.date_raw, '\\b(\\d{{3,4}})\\b', 1) AS INT), e.l1_no) FROM ev e WHERE e.file_id = i.file_id AND e.rx = i.rx AND e.rec_tag = 'INDI' AND e.tag = 'DEAT' AND regexp_matches(e.date_raw, '\\b\\d{{3,4}}\\b')) AS death
  FROM l i WHERE i.rec_tag = 'INDI' AND i.level <= 1 GROUP BY ALL)
"""


def _lit(s: str) -> str:
    return s.replace("'", "''")


def _lines(test: str, detail: str = "value") -> str:
    return f"SELECT file_id, lineno, rx AS xref, CAST({detail} AS VARCHAR) AS detail FROM l WHERE {test}"


def _lacks(parents: str, child: str, detail: str = "tag") -> str:
    return f"SELECT file_id, lineno, rx AS xref, {detail} AS detail FROM l a WHERE {parents} AND NOT EXISTS (SELECT 1 FROM k b WHERE b.file_id = a.file_id AND b.parent = a.lineno AND b.tag IN ({child}))"


def _place(v: str) -> str:
    return f"regexp_replace(regexp_replace(trim(regexp_replace(trim({v}), '^,+|,+$', '', 'g')), '\\s*,\\s*', ', ', 'g'), '\\s{{2,}}', ' ', 'g')"


def classify(part: str) -> str:
    p = f"trim({part})"
    return f"CASE WHEN {p} = '' THEN NULL WHEN regexp_matches({p}, '^\\d') OR regexp_matches(regexp_replace({p}, '^[A-Za-z]{{1,3}}\\.\\s+', ''), '(?i)\\b({text.STREET_WORDS})\\b') THEN 'addr' WHEN regexp_matches({p}, '(?i)\\b({text.VENUE_WORDS})\\b') THEN 'note' ELSE 'ambiguous' END"


def _in(values) -> str:  # noqa: ANN001
    return ", ".join(f"'{_lit(v)}'" for v in values)


_Y4 = "TRY_CAST(NULLIF(regexp_extract(coalesce(date_raw, ''), '\\b(\\d{4})\\b', 1), '') AS INT)"
_MON = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
_first = text.STREET_WORDS and "split_part(value, ',', 1)"
_fit = lambda tags: f"SELECT p.file_id, p.lineno, p.rx AS xref, p.tag || ' ' || p.target AS detail FROM ptr p WHERE p.tag IN ({_in(tags)}) AND NOT EXISTS (SELECT 1 FROM def d WHERE d.file_id = p.file_id AND d.target = p.target AND d.target_tag = CASE WHEN p.tag IN ('HUSB', 'WIFE', 'CHIL') THEN 'INDI' WHEN p.tag IN ('FAMS', 'FAMC') THEN 'FAM' ELSE p.tag END)"
_under = lambda c, p: f"SELECT file_id, lineno, rx AS xref, value AS detail FROM l a WHERE tag = '{c}' AND p_tag = '{p}' AND level = p_level + 1"
_kin = "FROM edge u JOIN vit v ON v.file_id = u.file_id AND v.xref = u.indi JOIN edge c ON c.file_id = u.file_id AND c.fam = u.fam AND c.role = 'CHIL' JOIN vit w ON w.file_id = c.file_id AND w.xref = c.indi WHERE u.role <> 'CHIL'"
_wed = "FROM edge u JOIN vit v ON v.file_id = u.file_id AND v.xref = u.indi JOIN (SELECT file_id, rx AS fam, min_by(CAST(regexp_extract(date_raw, '\\b(\\d{3,4})\\b', 1) AS INT), l1_no) AS married FROM ev WHERE rec_tag = 'FAM' AND tag = 'MARR' AND regexp_matches(date_raw, '\\b\\d{3,4}\\b') GROUP BY ALL) m ON m.file_id = u.file_id AND m.fam = u.fam WHERE u.role <> 'CHIL'"
_vital = lambda test, detail: f"SELECT file_id, CAST(0 AS BIGINT) AS lineno, xref, CAST({detail} AS VARCHAR) AS detail FROM vit WHERE {test}"
_kinq = lambda test, detail: f"SELECT u.file_id, CAST(0 AS BIGINT) AS lineno, c.indi AS xref, CAST({detail} AS VARCHAR) AS detail {_kin} AND {test}"
_fold = f"regexp_replace(raw, '[^{''.join(text.QUOTES)}]', '', 'g') <> ''"

SQL: dict[str, str] = {
    "date_no_year": _lines("tag = 'DATE' AND NOT regexp_matches(value, '\\b\\d{3,4}\\b')"),
    "date_bad_format": _lines(f"tag = 'DATE' AND level = 2 AND regexp_matches(value, '\\b\\d{{3,4}}\\b') AND NOT regexp_matches(trim(value), '{dates.GRAMMAR}')"),
    "date_month_caps": _lines(f"tag = 'DATE' AND len(list_filter(regexp_extract_all(value, '(?i)\\b({_MON})\\b'), lambda x: x <> upper(x))) > 0"),
    "dateless_date": _lines(f"tag = 'DATE' AND regexp_matches(value, '(?i)^\\s*\\d{{1,2}}\\s+({_MON})\\.?\\s*$')"),
    "name_double_spaces": _lines("tag = 'NAME' AND trim(regexp_replace(value, '  +', ' ', 'g')) <> value"),
    "long_line": _lines(f"length(raw) > {C.MAX_LINE}", "length(raw)"),
    "name_slashes": _lines("tag = 'NAME' AND length(value) - length(replace(value, '/', '')) > 2"),
    "name_slash_balance": _lines("tag = 'NAME' AND (length(value) - length(replace(value, '/', ''))) % 2 = 1"),
    "sex_value": _lines("tag = 'SEX' AND level = 1 AND trim(value) NOT IN ('M', 'F', 'U')"),
    "html_entity": _lines(f"regexp_matches(raw, '{text.ENTITY}') OR regexp_matches(raw, '{text.MARKUP}')"),
    "plac_spacing": _lines(f"tag = 'PLAC' AND value <> '' AND {_place('value')} <> value"),
    "blank_plac": _lines("tag = 'PLAC' AND level > 1 AND trim(value) = ''"),
    "plac_address_part": _lines(f"tag = 'PLAC' AND contains(value, ',') AND {classify(_first)} IN ('addr', 'note')", classify(_first)),
    "age_value": _lines(f"tag = 'AGE' AND (length(value) > 12 OR NOT regexp_matches(trim(value), '{dates.AGE}'))"),
    "resn_value": _lines("tag = 'RESN' AND lower(trim(value)) NOT IN ('confidential', 'locked', 'privacy')"),
    "pedi_value": _lines("tag = 'PEDI' AND lower(trim(value)) NOT IN ('adopted', 'birth', 'foster', 'sealing')"),
    "quay_value": _lines("tag = 'QUAY' AND trim(value) NOT IN ('', '0', '1', '2', '3')"),
    "occu_length": _lines(f"tag = 'OCCU' AND length(value) > {C.MAX_OCCU}", "length(value)"),
    "bare_at_sign": _lines("NOT regexp_matches(trim(value), '^@[^@]+@$') AND contains(regexp_replace(replace(value, '@@', ''), '@[^@\\s]+@', '', 'g'), '@')"),
    "nickname_in_name": _lines("tag = 'NAME' AND regexp_matches(split_part(value, '/', 1), '\"[^\"]+\"')"),
    "curly_quotes": _lines(_fold),
    "unknown_surname": _lines("(tag = 'NAME' AND contains(upper(value), '/UNKNOWN/')) OR (tag = 'SURN' AND upper(trim(value)) = 'UNKNOWN')"),
    "occupation_ignored": _lines(f"tag = 'OCCU' AND lower(trim(value)) IN ({_in(text.IGNORED_OCCUPATIONS)})"),
    "grammar": _lines(f"trim(raw) <> '' AND NOT regexp_matches(raw, '{C.LINE}')", "raw"),
    "short_conc": _lines(f"tag = 'CONC' AND length(value) < {C.SHORT_CONC}"),
    "malformed_xref": f"SELECT file_id, lineno, rx AS xref, kind AS detail FROM (SELECT *, unnest(list_filter([CASE WHEN length(r) > {C.MAX_XREF} THEN 'long' END, CASE WHEN contains(r, ' ') THEN 'space' END, CASE WHEN NOT regexp_matches(substr(r, 2, 1), '[A-Za-z0-9_]') THEN 'start' END], lambda x: x IS NOT NULL)) AS kind FROM (SELECT *, coalesce(xref, CASE WHEN regexp_matches(trim(value), '^@[^@]+@$') THEN trim(value) END) AS r FROM l) WHERE r IS NOT NULL)",
    "level_jump": "SELECT file_id, lineno, rx AS xref, p_level || '>' || level AS detail FROM l WHERE level > p_level + 1",
    "trailing_whitespace": _lines("rtrim(raw) <> raw AND coalesce(n_tag, '') <> 'CONC'", "''"),
    "conc_cont_level": "SELECT file_id, lineno, xref, before || '>' || level AS detail FROM (SELECT file_id, lineno, rx AS xref, level, tag, last_value(CASE WHEN tag NOT IN ('CONC', 'CONT') THEN level END IGNORE NULLS) OVER (PARTITION BY file_id, rec_no ORDER BY lineno) AS before FROM l) WHERE tag IN ('CONC', 'CONT') AND level <> before + 1",
    "mid_word_conc": "SELECT file_id, lineno, rx AS xref, right(prev, 1) || '|' || left(value, 4) AS detail FROM (SELECT *, lag(value) OVER (PARTITION BY file_id, rec_no ORDER BY lineno) AS prev FROM l WHERE rec_tag = 'NOTE' AND (level = 0 OR tag IN ('CONC', 'CONT'))) WHERE tag = 'CONC' AND regexp_matches(prev, '\\p{L}$') AND regexp_matches(value, '^\\p{Ll}')",
    "addr_under_plac": _under("ADDR", "PLAC"),
    "note_under_plac": _under("NOTE", "PLAC"),
    "note_under_addr": _under("NOTE", "ADDR"),
    "record_order": "SELECT file_id, lineno, xref, tag AS detail FROM (SELECT *, max(rank) OVER (PARTITION BY file_id ORDER BY lineno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM (SELECT file_id, lineno, rx AS xref, tag, coalesce(list_position(['HEAD', 'SUBM', 'INDI', 'FAM', 'SOUR', 'REPO', 'OBJE', 'NOTE'], tag) - 1, 8) AS rank FROM l WHERE level = 0 AND tag <> 'TRLR')) WHERE rank < most",
    "bare_event": _lines("tag IN ('BIRT', 'CHR', 'DEAT') AND level = 1 AND trim(value) = '' AND coalesce(n_level, 0) < 2", "tag"),
    "untyped_event": _lacks("tag IN ('EVEN', 'FACT', 'IDNO') AND level = 1", "'TYPE'"),
    "missing_sex": _lacks("level = 0 AND tag = 'INDI'", "'SEX'"),
    "missing_name": _lacks("level = 0 AND tag = 'INDI'", "'NAME'"),
    "sour_without_titl": _lacks("level = 0 AND tag = 'SOUR'", "'TITL'"),
    "asso_without_rela": _lacks("level = 1 AND tag = 'ASSO' AND rec_tag = 'INDI'", "'RELA'", "value"),
    "source_without_origin": "SELECT file_id, min(lineno) AS lineno, rx AS xref, '' AS detail FROM l WHERE rec_tag = 'SOUR' AND level <= 1 GROUP BY file_id, rec_no, rx HAVING bool_or(tag = 'TITL') AND NOT bool_or(tag IN ('AUTH', 'PUBL', 'REPO'))",
    "citation_without_page": "SELECT file_id, lineno, rx AS xref, source AS detail FROM cit WHERE rec_tag <> 'SOUR' AND coalesce(page, '') = ''",
    "header_fields": "SELECT file_id, CAST(0 AS BIGINT) AS lineno, '' AS xref, x AS detail FROM (SELECT file_id, unnest(list_filter([CASE WHEN NOT bool_or(level = 1 AND tag = 'SOUR') THEN 'SOUR' END, CASE WHEN NOT bool_or(level = 1 AND tag = 'SUBM') THEN 'SUBM' END, CASE WHEN NOT bool_or(level = 1 AND tag = 'GEDC') THEN 'GEDC' END, CASE WHEN NOT bool_or(level = 2 AND tag = 'VERS') THEN 'GEDC.VERS' END, CASE WHEN NOT bool_or(level = 2 AND tag = 'FORM' AND upper(trim(value)) = 'LINEAGE-LINKED') THEN 'GEDC.FORM' END, CASE WHEN NOT bool_or(level = 1 AND tag = 'CHAR') THEN 'CHAR' END], lambda x: x IS NOT NULL)) AS x FROM l WHERE rec_tag = 'HEAD' AND level > 0 GROUP BY file_id)",
    "plac_form": "SELECT file_id, lineno, rx AS xref, value AS detail FROM k WHERE rec_tag = 'HEAD' AND tag = 'FORM' AND parent_tag = 'PLAC'",
    "name_pieces": "SELECT a.file_id, a.lineno, a.rx AS xref, concat_ws(',', CASE WHEN count(*) FILTER (b.tag = 'GIVN') = 0 THEN 'GIVN' END, CASE WHEN count(*) FILTER (b.tag = 'SURN') = 0 THEN 'SURN' END) AS detail FROM l a LEFT JOIN k b ON b.file_id = a.file_id AND b.parent = a.lineno WHERE a.tag = 'NAME' AND a.level = 1 AND contains(a.value, '/') GROUP BY a.file_id, a.lineno, a.rx HAVING count(*) FILTER (b.tag = 'GIVN') = 0 OR count(*) FILTER (b.tag = 'SURN') = 0",
    "fact_aka": "SELECT a.file_id, a.lineno, a.rx AS xref, n.value AS detail FROM l a JOIN k t ON t.file_id = a.file_id AND t.parent = a.lineno AND t.tag = 'TYPE' AND upper(trim(t.value)) = 'AKA' JOIN k n ON n.file_id = a.file_id AND n.parent = a.lineno AND n.tag = 'NOTE' WHERE a.level = 1 AND a.tag = 'FACT'",
    "citation_data_child": "SELECT b.file_id, b.lineno, b.rx AS xref, b.tag AS detail FROM k a JOIN k b ON b.file_id = a.file_id AND b.parent = a.lineno WHERE a.tag = 'DATA' AND a.parent_tag = 'SOUR' AND a.parent_level > 0 AND b.tag NOT IN ('DATE', 'TEXT', 'CONC', 'CONT')",
    "sole_event_alternate": "SELECT file_id, l1_no AS lineno, rx AS xref, tag AS detail FROM (SELECT *, count(*) OVER (PARTITION BY file_id, rec_no, tag) AS n FROM ev WHERE rec_tag = 'INDI' AND tag IN ('BIRT', 'DEAT')) WHERE n = 1 AND lower(type) = 'alternate'",
    "bapm_without_birth": f"SELECT file_id, min(l1_no) FILTER (tag IN ('BAPM', 'CHR') AND y IS NOT NULL) AS lineno, rx AS xref, CAST(min_by(y, l1_no) FILTER (tag IN ('BAPM', 'CHR') AND y IS NOT NULL) AS VARCHAR) AS detail FROM (SELECT *, {_Y4} AS y FROM ev WHERE rec_tag = 'INDI') GROUP BY file_id, rec_no, rx HAVING count(*) FILTER (tag IN ('BAPM', 'CHR') AND y IS NOT NULL) > 0 AND NOT bool_or(tag = 'BIRT' AND date_raw IS NOT NULL)",
    "presumed_deceased": f"SELECT file_id, min(l1_no) AS lineno, rx AS xref, CAST(min_by(y, l1_no) FILTER (tag = 'BIRT' AND y IS NOT NULL) AS VARCHAR) AS detail FROM (SELECT *, {_Y4} AS y FROM ev WHERE rec_tag = 'INDI') GROUP BY file_id, rec_no, rx HAVING min_by(y, l1_no) FILTER (tag = 'BIRT' AND y IS NOT NULL) <= {2026 - C.DECEASED} AND NOT bool_or(tag = 'DEAT')",
    "empty_fact": "SELECT file_id, lineno, rx AS xref, tag AS detail FROM l a WHERE tag IN ('FACT', 'EVEN') AND level = 1 AND trim(value) = '' AND rec_tag = 'INDI' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.file_id = a.file_id AND b.parent = a.lineno AND b.level = 2 AND b.tag IN ('DATE', 'PLAC', 'NOTE'))",
    "name_piece_order": "SELECT file_id, parent AS lineno, rx AS xref, 'TYPE' AS detail FROM k WHERE parent_tag = 'NAME' GROUP BY ALL HAVING min(k.lineno) FILTER (tag = 'TYPE') < max(k.lineno) FILTER (tag IN ('GIVN', 'SURN', 'NSFX', 'NPFX'))",
    "event_source_order": f"SELECT DISTINCT file_id, parent AS lineno, rx AS xref, '' AS detail FROM (SELECT *, max(key) OVER (PARTITION BY file_id, parent ORDER BY lineno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM (SELECT *, CASE tag WHEN 'NOTE' THEN 2 WHEN 'SOUR' THEN 1 ELSE 0 END AS key FROM k WHERE level = 2 AND parent_tag IN ({_in(L.EVENT_TAGS)}) AND tag NOT IN ('CONC', 'CONT'))) WHERE key < most",
    "name_piece_case": "SELECT file_id, lineno, rx AS xref, value AS detail FROM k WHERE tag IN ('GIVN', 'SURN', 'NSFX', 'NPFX') AND parent_tag = 'NAME' AND value = upper(value) AND regexp_matches(value, '\\p{L}') AND NOT (parent_value = upper(parent_value) AND regexp_matches(parent_value, '\\p{L}'))",
    "duplicate_citation": "SELECT file_id, lineno, rx AS xref, source AS detail FROM (SELECT *, row_number() OVER (PARTITION BY file_id, l1_no, source, children ORDER BY lineno) AS nth FROM cit WHERE l1_no IS NOT NULL AND level > 1) WHERE nth > 1",
    "same_source_twice": "SELECT file_id, lineno, rx AS xref, source AS detail FROM (SELECT *, row_number() OVER (PARTITION BY file_id, l1_no, source ORDER BY lineno) AS nth FROM cit WHERE l1_no IS NOT NULL AND level > 1) WHERE nth > 1",
    "duplicate_resi": "SELECT file_id, l1_no AS lineno, rx AS xref, concat_ws('; ', date_raw, place) AS detail FROM (SELECT *, row_number() OVER (PARTITION BY file_id, rec_no, date_raw, place ORDER BY l1_no) AS nth FROM ev WHERE tag = 'RESI' AND rec_tag = 'INDI') WHERE nth > 1",
    "duplicate_event": "SELECT file_id, min(l1_no) AS lineno, rx AS xref, tag AS detail FROM ev WHERE tag IN ('BIRT', 'DEAT') GROUP BY file_id, rec_no, rx, tag, date_raw, place HAVING count(*) > 1",
    "duplicate_name": "SELECT file_id, min(lineno) AS lineno, rx AS xref, value AS detail FROM l WHERE rec_tag = 'INDI' AND level = 1 AND tag = 'NAME' GROUP BY file_id, rec_no, rx, value HAVING count(*) > 1",
    "citation_excess": f"SELECT file_id, l1_no AS lineno, rx AS xref, 'excessive ' || count(*) AS detail FROM cit WHERE rec_tag = 'INDI' AND l1_no IS NOT NULL AND level > 1 GROUP BY file_id, l1_no, rx HAVING count(*) > {C.MAX_CITATIONS} UNION ALL SELECT file_id, l1_no, rx, 'duplicate ' || source FROM cit WHERE rec_tag = 'INDI' AND l1_no IS NOT NULL AND level > 1 GROUP BY file_id, l1_no, rx, source, coalesce(page, '') HAVING count(*) > 1",
    "godparent_count": "SELECT a.file_id, min(a.lineno) AS lineno, a.rx AS xref, count(*) || '/' || count(*) FILTER (v.sex = 'M') || '/' || count(*) FILTER (v.sex = 'F') AS detail FROM l a JOIN k r ON r.file_id = a.file_id AND r.parent = a.lineno AND r.tag = 'RELA' AND lower(trim(r.value)) = 'godparent' LEFT JOIN vit v ON v.file_id = a.file_id AND v.xref = trim(a.value) WHERE a.tag = 'ASSO' AND a.level = 1 AND a.rec_tag = 'INDI' GROUP BY a.file_id, a.rec_no, a.rx HAVING count(*) > 2 OR count(*) FILTER (v.sex = 'M') > 1 OR count(*) FILTER (v.sex = 'F') > 1",
    "broken_xref": _fit(["HUSB", "WIFE", "CHIL", "FAMS", "FAMC", "OBJE", "SOUR", "REPO"]),
    "dangling_note": _fit(["NOTE"]),
    "family_pointer_type": _fit(["FAMC", "FAMS"]),
    "person_pointer_type": _fit(["HUSB", "WIFE", "CHIL"]),
    "unresolved_pointer": "SELECT p.file_id, p.lineno, p.rx AS xref, p.tag || ' ' || p.target AS detail FROM ptr p WHERE p.tag <> '_MTTAG' AND NOT EXISTS (SELECT 1 FROM def d WHERE d.file_id = p.file_id AND d.target = p.target)",
    "duplicate_xref": "SELECT file_id, min(lineno) AS lineno, xref, CAST(count(*) AS VARCHAR) AS detail FROM l WHERE level = 0 AND xref IS NOT NULL GROUP BY file_id, xref HAVING count(*) > 1",
    "one_way_pointer": "SELECT p.file_id, p.lineno, p.rx AS xref, p.tag || ' ' || p.target AS detail FROM ptr p JOIN def d ON d.file_id = p.file_id AND d.target = p.target WHERE p.level = 1 AND p.tag IN ('HUSB', 'WIFE', 'CHIL', 'FAMS', 'FAMC') AND NOT EXISTS (SELECT 1 FROM ptr b WHERE b.level = 1 AND b.file_id = p.file_id AND b.rx = p.target AND b.target = p.rx AND ((p.tag IN ('HUSB', 'WIFE', 'FAMS') AND b.tag IN ('HUSB', 'WIFE', 'FAMS')) OR (p.tag IN ('CHIL', 'FAMC') AND b.tag IN ('CHIL', 'FAMC'))))",
    "death_before_birth": _vital("death < birth", "birth - death"),
    "future_date": _vital("birth > 2026 OR death > 2026", "greatest(birth, death)"),
    "parent_too_young": _kinq(f"w.birth - v.birth < {C.PARENT_AGES[0]}", "w.birth - v.birth"),
    "parent_too_old": _kinq(f"w.birth - v.birth > {C.PARENT_AGES[1]}", "w.birth - v.birth"),
    "posthumous_birth": _kinq(f"w.birth > v.death + {C.POSTHUMOUS}", "w.birth - v.death"),
    "spouse_sex": "SELECT u.file_id, u.ord AS lineno, u.fam AS xref, u.indi AS detail FROM edge u JOIN vit v ON v.file_id = u.file_id AND v.xref = u.indi WHERE (u.role = 'HUSB' AND v.sex = 'F') OR (u.role = 'WIFE' AND v.sex = 'M')",
    "self_marriage": "SELECT file_id, CAST(ord AS BIGINT) AS lineno, xref, husb AS detail FROM fam WHERE husb = wife",
    "marriage_before_birth": f"SELECT u.file_id, u.ord AS lineno, u.fam AS xref, u.indi AS detail {_wed} AND m.married < v.birth",
    "marriage_after_death": f"SELECT u.file_id, u.ord AS lineno, u.fam AS xref, u.indi AS detail {_wed} AND m.married > v.death",
    "godparent_one_way": "SELECT a.file_id, a.lineno, a.rx AS xref, a.t AS detail FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.file_id = a.file_id AND b.rx = a.t AND b.t = a.rx AND (b.r = 'godchild') <> (a.r = 'godchild'))",
    "orphaned_individual": "SELECT file_id, lineno, rx AS xref, tag AS detail FROM l a WHERE level = 0 AND tag = 'INDI' AND NOT EXISTS (SELECT 1 FROM l b WHERE b.file_id = a.file_id AND b.rec_no = a.rec_no AND b.level = 1 AND b.tag IN ('FAMS', 'FAMC', 'ASSOC'))",
    "empty_family": f"SELECT file_id, min(lineno) AS lineno, rx AS xref, '' AS detail FROM l WHERE rec_tag = 'FAM' AND level <= 1 GROUP BY file_id, rec_no, rx HAVING bool_or(tag IN ('HUSB', 'WIFE')) AND NOT bool_or(tag IN ('CHIL', 'SOUR', {_in(L.EVENT_TAGS)}))",
    "memberless_family": _lacks("level = 0 AND tag = 'FAM'", "'HUSB', 'WIFE', 'CHIL'"),
    "duplicate_family": "SELECT file_id, CAST(ord AS BIGINT) AS lineno, xref, prev AS detail FROM (SELECT *, lag(xref) OVER (PARTITION BY file_id, coalesce(husb, ''), coalesce(wife, '') ORDER BY ord) AS prev FROM fam WHERE husb IS NOT NULL OR wife IS NOT NULL) WHERE prev IS NOT NULL",
    "duplicate_source_title": "SELECT file_id, CAST(ord AS BIGINT) AS lineno, xref, prev AS detail FROM (SELECT *, lag(xref) OVER (PARTITION BY file_id, t ORDER BY ord) AS prev FROM (SELECT file_id, rec_no AS ord, rx AS xref, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(strip_accents(value)), '[!-/:-@\\[-`{-~\\s]+', ' ', 'g'), ' '), lambda x: length(x) > 1))), ' ') AS t FROM l WHERE rec_tag = 'SOUR' AND level = 1 AND tag = 'TITL') WHERE t <> '') WHERE prev IS NOT NULL",
    "duplicate_source_record": "SELECT file_id, CAST(ord AS BIGINT) AS lineno, xref, prev AS detail FROM (SELECT *, lag(xref) OVER (PARTITION BY file_id, body ORDER BY ord) AS prev FROM (SELECT file_id, rec_no AS ord, rx AS xref, string_agg(tag || ' ' || value, chr(10) ORDER BY tag || ' ' || value) AS body FROM l WHERE rec_tag = 'SOUR' AND tag IN ('TITL', 'AUTH', 'PUBL') GROUP BY ALL)) WHERE prev IS NOT NULL",
    "orphaned_source": "SELECT file_id, lineno, rx AS xref, tag AS detail FROM l a WHERE level = 0 AND tag = 'SOUR' AND NOT EXISTS (SELECT 1 FROM cit c WHERE c.file_id = a.file_id AND c.source = a.rx)",
    "redundant_page": "SELECT c.file_id, c.lineno, c.rx AS xref, c.page AS detail FROM cit c JOIN l t ON t.file_id = c.file_id AND t.rx = c.source AND t.rec_tag = 'SOUR' AND t.level = 1 AND t.tag = 'TITL' WHERE t.value <> '' AND regexp_replace(lower(trim(c.page)), 's$', '') = regexp_replace(lower(trim(t.value)), 's$', '')",
    "nonstandard_tag": "SELECT file_id, min(lineno) AS lineno, '' AS xref, tag || ' ' || count(*) AS detail FROM l WHERE tag LIKE '\\_%' ESCAPE '\\' GROUP BY file_id, tag",
    "starts_and_ends": "SELECT file_id, lineno, '' AS xref, unnest(list_filter([CASE WHEN NOT starts_with(f, '0 HEAD') THEN 'HEAD' END, CASE WHEN NOT starts_with(e, '0 TRLR') THEN 'TRLR' END], lambda x: x IS NOT NULL)) AS detail FROM (SELECT file_id, min_by(raw, lineno) AS f, max_by(raw, lineno) AS e, max(lineno) AS lineno FROM l WHERE trim(raw) <> '' GROUP BY file_id)",
}
SQL["date_consistency"] = (
    "SELECT file_id, CAST(0 AS BIGINT) AS lineno, xref, unnest(list_filter([CASE WHEN b > d THEN 'birth>death' END, CASE WHEN c < b THEN 'baptism<birth' END, CASE WHEN u < d THEN 'burial<death' END], lambda x: x IS NOT NULL)) AS detail FROM w "
    "UNION ALL SELECT e.file_id, 0, e.indi, 'marriage<birth' FROM edge e JOIN w ON w.file_id = e.file_id AND w.xref = e.indi JOIN m ON m.file_id = e.file_id AND m.fam = e.fam WHERE e.role <> 'CHIL' AND m.y < w.b "
    "UNION ALL SELECT e.file_id, 0, c.indi, unnest(list_filter([CASE WHEN z.b <= w.b THEN 'child<=parent' END, CASE WHEN z.b > w.d + 1 THEN 'child>death' END], lambda x: x IS NOT NULL)) FROM edge e JOIN w ON w.file_id = e.file_id AND w.xref = e.indi JOIN edge c ON c.file_id = e.file_id AND c.fam = e.fam AND c.role = 'CHIL' JOIN w z ON z.file_id = c.file_id AND z.xref = c.indi WHERE e.role <> 'CHIL'"
)
#: Further tables that some rules need.
MORE = {
    "godparent_one_way": ", g AS (SELECT a.file_id, a.lineno, a.rx, trim(a.value) AS t, lower(trim(b.value)) AS r FROM l a JOIN k b ON b.file_id = a.file_id AND b.parent = a.lineno AND b.tag = 'RELA' WHERE a.tag = 'ASSO' AND a.level = 1 AND lower(trim(b.value)) IN ('godparent', 'godfather', 'godmother', 'godchild'))",
    "date_consistency": f", y AS (SELECT *, {_Y4} AS y FROM ev WHERE {_Y4} IS NOT NULL), w AS (SELECT file_id, rx AS xref, max_by(y, l1_no) FILTER (tag = 'BIRT') AS b, max_by(y, l1_no) FILTER (tag = 'DEAT') AS d, max_by(y, l1_no) FILTER (tag IN ('CHR', 'BAPM')) AS c, max_by(y, l1_no) FILTER (tag = 'BURI') AS u FROM y WHERE rec_tag = 'INDI' GROUP BY ALL), m AS (SELECT file_id, rx AS fam, min_by(y, l1_no) AS y FROM y WHERE rec_tag = 'FAM' AND tag = 'MARR' GROUP BY ALL)",
}


def oracle(name: str) -> str | None:
    return PREFIX + MORE.get(name, "") + SQL[name] if name in SQL else None
