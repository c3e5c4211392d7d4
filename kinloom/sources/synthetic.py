"""Lineage lines made of the star-schema tables, with the same SQL expressions for Spark and for DuckDB.

A person for each customer, a family for each four, a source for each eight; defects of every kind come by
arithmetic on the key, so that each rule has something to find. 240 people make a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_GIVEN = "split_part('Anna|José|Karl|MARIE|Björn|Ellen|Renée', '|', cast(k % 7 + 1 as int))"
_SURNAME = "split_part('Olsen|van der Berg|Müller|Smith|Ødegård|Smyth|García|O''Brien|Brown|Schmidt|Lee', '|', cast(k % 11 + 1 as int))"
_YEAR = "cast(1700 + (k * 37) % 230 as string)"
_PLACE = "split_part('Oslo, Norway|  Berlin ,Germany|12 Main Street, Boston, Massachusetts, USA|Paris,, France|St. Mary Church, London, England|Deutschland|Oslo,Norway,', '|', cast(k % 7 + 1 as int))"
_DATE = f"split_part('1 JAN {{y}}|Feb {{y}}|about {{y}}|{{y}}-03-15|BET {{y}} AND 1999|31 Dec|c. {{y}}|{{y}}|3 mar {{y}}|before {{y}}|AFT {{y}}|12/24/{{y}}|unknown', '|', cast(k % 13 + 1 as int))".replace("{y}", f"' || {_YEAR} || '")


def _if(test: str, text: str) -> str:
    return f"case when {test} then {text} end"


def _person() -> list[str]:
    name = f"{_GIVEN} || case when k % 19 = 0 then ' \"Jack\"' when k % 17 = 0 then '  Lee' else '' end || ' /' || case when k % 31 = 0 then 'UNKNOWN' when k % 23 = 0 then upper({_SURNAME}) else {_SURNAME} end || '/' || case when k % 29 = 0 then ' Jr/' else '' end"
    lead = "'0 @I' || cast(k as string) || '@ INDI'"
    sour = "'2 SOUR @S' || cast(k - k % 8 as string) || '@'"
    return [
        lead, _if("k % 97 <> 0", f"'1 NAME ' || {name}"), _if("k % 21 = 0", "'2 TYPE birth'"), _if("k % 4 <> 0", f"'2 GIVN ' || {_GIVEN}"), _if("k % 4 <> 0", f"'2 SURN ' || {_SURNAME}"),
        _if("k % 37 = 0", f"'1 NAME ' || {name}"), _if("k % 35 <> 0", "'1 SEX ' || case when k % 33 = 0 then 'X' when k % 44 = 0 then 'F' when k % 2 = 0 then 'M' else 'F' end"),
        "'1 BIRT'", _if("k % 9 <> 0", f"'2 DATE ' || {_DATE}"), _if("k % 9 <> 0", f"'2 PLAC ' || {_PLACE}"), _if("k % 15 = 0", "'3 NOTE near the church'"), _if("k % 51 = 1", "'2 PLAC Rome, Italy'"), _if("k % 51 = 1", "'3 ADDR 5 Via Roma'"), _if("k % 53 = 1", "'2 ADDR 7 High Road'"), _if("k % 53 = 1", "'3 NOTE the old mill'"), _if("k % 62 = 1", "'2 PLAC '"),
        _if("k % 9 <> 0", sour), _if("k % 9 <> 0 and k % 5 <> 0", "'3 PAGE ' || case when k % 47 = 1 then 'a history of Berlin' else 'p. ' || cast(k % 3 as string) end"), _if("k % 66 = 1", "'3 QUAY 9'"), _if("k % 55 = 1", "'3 DATA'"), _if("k % 55 = 1", "'4 WWW example'"), _if("k % 10 = 1", sour), _if("k % 10 = 1 and k % 5 <> 0", "'3 PAGE p. ' || cast(k % 3 as string)"),
        _if("k % 14 = 0", "'1 BIRT'"), _if("k % 14 = 0", f"'2 DATE {{}} ' || {_YEAR}".format("ABT")), _if("k % 14 = 0 or k % 38 = 0", "'2 TYPE alternate'"),
        _if("k % 28 = 0", "'1 BIRT'"), _if("k % 28 = 0", f"'2 DATE ABT ' || {_YEAR}"), _if("k % 3 = 0", "'1 DEAT'"), _if("k % 3 = 0", "'2 DATE ' || cast(case when k % 99 = 0 then 2099 else 1690 + k % 290 end as string)"), _if("k % 3 = 0", "'2 AGE ' || split_part('45y|300|STILLBORN|7y 3m|about 50|< 1y', '|', cast(k % 6 + 1 as int))"),
        _if("k % 12 = 0", "'1 RESI'"), _if("k % 12 = 0", "'2 DATE 1850'"), _if("k % 12 = 0", "'2 PLAC Oslo, Norway'"), _if("k % 24 = 0", "'1 RESI'"), _if("k % 24 = 0", "'2 DATE 1850'"), _if("k % 24 = 0", "'2 PLAC Oslo, Norway'"),
        _if("k % 16 = 0", "'1 OCCU ' || rpad('Keeper of', 100 + cast(k % 64 as int), ' books')"), _if("k % 46 = 0", "'1 OCCU Retired'"), _if("k % 18 = 0", "'1 EVEN'"), _if("k % 22 = 0", "'1 FACT'"), _if("k % 22 = 0", "'2 TYPE AKA'"), _if("k % 22 = 0", "'2 NOTE Annie Berg'"),
        _if("k % 20 = 0", "'1 _MILT'"), _if("k % 20 = 0", "'2 DATE 1916'"), _if("k % 26 = 0", "'1 _HEIG 180 cm'"), _if("k % 6 = 0", "'1 ASSO @I' || cast(k + 1 as string) || '@'"), _if("k % 6 = 0 and k % 30 <> 0", "'2 RELA Godparent'"),
        _if("k % 36 = 0", "'1 ASSO @I' || cast(k + 2 as string) || '@'"), _if("k % 36 = 0", "'2 RELA godparent'"), _if("k % 36 = 0", "'1 ASSO @I' || cast(k + 3 as string) || '@'"), _if("k % 36 = 0", "'2 RELA Godparent'"),
        _if("k % 7 = 0", "'1 NOTE Came by sh'"), _if("k % 7 = 0", "case when k % 21 = 0 then '3 CONC ip  ' else '2 CONC ip ' end"), _if("k % 7 = 0", "'2 CONT and stayed'"), _if("k % 28 = 0", "'1 NOTE <b>bold</b> &amp; more'"), _if("k % 32 = 0", "'1 NOTE it’s “here”  '"), _if("k % 34 = 0", "'1 EMAIL a@b.example'"),
        _if("k % 58 = 0", "'1 NOTE ' || rpad('so', 300, ' on')"), _if("k % 95 = 0", "'no level here'"), _if("k % 96 = 0", "'1 SUBM @-bad ref@'"), _if("k % 25 = 0", "'1 CHAN'"), _if("k % 25 = 0", "'3 DATE 1 JAN 2001'"), _if("k % 39 = 0", "'1 RESN secret'"), _if("k % 40 = 1", "'1 BAPM'"), _if("k % 40 = 1", f"'2 DATE 5 MAY ' || {_YEAR}"),
        _if("k % 4 <= 1", "'1 FAMS @F' || cast(case when k % 27 = 0 then 900000 + k else k - k % 4 end as string) || '@'"), _if("k % 4 > 1 and k % 45 <> 0", "'1 FAMC @F' || cast(k - k % 4 as string) || '@'"), _if("k % 4 > 1 and k % 50 = 2", "'2 PEDI step'"),
        _if("k % 43 = 0", "'1 NOTE @N' || cast(k as string) || '@'"),
    ]


def _family() -> list[str]:
    i = lambda n: f"'@I' || cast(k + {n} as string) || '@'"
    return [
        "'0 @F' || cast(k as string) || '@ FAM'", _if("k % 52 <> 0", "'1 HUSB ' || " + i(0)), _if("k % 56 <> 0", "'1 WIFE @I' || cast(case when k % 68 = 0 then k else k + 1 end as string) || '@'"), "'1 CHIL ' || " + i(2), _if("k % 16 <> 0", "'1 CHIL ' || " + i(3)), _if("k % 64 = 0", "'1 CHIL @S8@'"),
        _if("k % 12 <> 0", "'1 MARR'"), _if("k % 12 <> 0", f"'2 DATE ' || cast(1700 + (k * 7) % 260 as string)"), _if("k % 60 = 0", "'1 MARR'"), _if("k % 60 = 0", "'2 DATE 1800'"), _if("k % 48 = 0", "'1 DIV'"),
    ]


def _twin_family() -> list[str]:
    return ["'0 @F' || cast(k as string) || case when k % 80 = 0 then '' else 'B' end || '@ FAM'", _if("k % 120 <> 0", "'1 HUSB @I' || cast(k as string) || '@'"), _if("k % 120 <> 0", "'1 WIFE @I' || cast(k + 1 as string) || '@'")]


def _source() -> list[str]:
    title = "split_part('Parish register of Oslo|Census 1850, Boston|A history of Berlin|Oslo parish register|The Boston census 1850', '|', cast((k / 8) % 5 + 1 as int))"
    return [
        "'0 @S' || cast(k as string) || '@ SOUR'", _if("k % 72 <> 0", f"'1 TITL ' || {title}"), _if("k % 24 = 0", "'1 AUTH Nils Berg'"), _if("k % 40 = 0", "'1 PUBL Oslo, ' || cast(1800 + k % 90 as string)"), _if("k % 56 = 0", "'1 REPO @R1@'"),
    ]


def _note() -> list[str]:
    return ["'0 @N' || cast(k as string) || '@ NOTE A long no'", "'1 CONC te t'", "'1 CONC hat goes on'", "'1 CONT and ends'"]


def _head() -> list[str]:
    return ["'0 HEAD'", _if("g % 2 = 0", "'1 SOUR kinloom'"), "'1 GEDC'", "'2 VERS 5.5.1'", _if("g % 3 = 0", "'2 FORM LINEAGE-LINKED'"), "'1 CHAR UTF-8'", "'1 PLAC'", "'2 FORM City, County, State, Country'"]


#: (which rows of customer, first line number, lines). Families of k % 88 = 0 stand before the people.
SECTIONS = [
    ("k % 240 = 0", "0", _head()), ("true", "1000 + (k % 240) * 75", _person()), ("k % 4 = 0", "case when k % 88 = 0 then 100 else 20000 end + (k % 240) * 3", _family()),
    ("k % 40 = 0", "30000 + k % 240", _twin_family()), ("k % 8 = 0", "40000 + (k % 240) * 2", _source()), ("k % 100 = 0", "50000 + k % 240", ["'0 @X' || cast(k as string) || '@ SOUR'", "'1 TITL Unused'"]), ("k % 11 = 0", "60000 + (k % 240) * 2", _note()), ("k % 240 = 0", "99999", [_if("g % 3 <> 1", "'0 TRLR'")]),
]
_BASE = "(SELECT c_custkey AS k, cast(floor(c_custkey / 240) as bigint) AS g FROM customer)"


def spark_sql() -> str:
    part = lambda test, start, rows: f"SELECT g, {start} AS start, posexplode(array({', '.join(rows)})) AS (i, raw) FROM {_BASE} WHERE {test}"
    return " UNION ALL ".join(f"SELECT 'f' || cast(g as string) AS file_id, cast(start + i * 1 as bigint) AS lineno, raw FROM ({part(*s)}) WHERE raw IS NOT NULL" for s in SECTIONS)


def duckdb_sql() -> str:
    part = lambda test, start, rows: f"SELECT g, {start} AS start, unnest([{', '.join(rows)}]) AS raw, unnest(range({len(rows)})) AS i FROM {_BASE} WHERE {test}"
    text = " UNION ALL ".join(f"SELECT 'f' || cast(g as varchar) AS file_id, cast(start + i AS bigint) AS lineno, raw FROM ({part(*s)}) WHERE raw IS NOT NULL" for s in SECTIONS)
    return text.replace(" as string)", " as varchar)").replace("as int)", "as int)")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # a task for each 20,000 people, however few pieces the file can be read in
    if (tasks := -(-customers.count() // 20_000)) > 1:
        customers = customers.select("c_custkey").repartition(tasks, "c_custkey")
    customers.createOrReplaceTempView("customer")
    return spark.sql(spark_sql())
