"""Scanning level-tagged lineage files (the 5.5.1 lineage-linked text format) into tables.

``lines`` has a row for each physical line: file_id, lineno, raw, level, xref, tag, value, rec_no, rec_xref,
rec_tag, l1_no, parent_lineno. ``nodes`` has a row for each logical node: continuation lines are folded in.
Windows are by file only where record numbers are made, and by record from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: level, cross-reference, tag, value
GRAMMAR = r"^\s*(\d+)(?:\s+(@[^@]+@))?\s+(\S+)(?: (.*))?$"
#: Heads of records, and the lines that ``sources`` reads of them.
SOURCE_LINES = r"^\s*0*(?:0\s|1\s+(?:@[^@]+@\s+)?(?:TITL|AUTH|PUBL|REPO|REFN)(?:\s|$))"
POINTER = r"^@[^@]+@$"
#: Levels below this have a window each in the search for parents; lines below deeper ones look through a list of those.
SHALLOW = 6
#: What the bytes 0x80 to 0x9F mean in code page 1252 (fixed values; five are not used there and stay).
CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž",
    0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
EVENT_TAGS = (
    "BIRT CHR BAPM DEAT BURI CREM ADOP CONF GRAD OCCU RETI RESI EMIG IMMI NATU CENS EDUC EVEN FACT PROB WILL MARR DIV".split()
)
#: Events and attributes whose children have an order: details, sources, notes.
ORDERED_TAGS = (
    "BIRT CHR DEAT BURI CREM ADOP BAPM BARM BASM BLES CHRA CONF FCOM ORDN NATU EMIG IMMI CENS PROB WILL GRAD RETI EVEN "
    "CAST DSCR EDUC IDNO NATI NCHI NMR OCCU PROP RELI RESI SSN TITL FACT ANUL DIV DIVF ENGA MARB MARC MARL MARR MARS".split()
)


def by_file() -> WindowSpec:
    return W.partitionBy("file_id").orderBy("lineno")


def by_record() -> WindowSpec:
    return W.partitionBy("file_id", "rec_no").orderBy("lineno")


def read_raw(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(file_id, lineno, raw) of each file below path; a file is one task's work. A byte-order mark decides (UTF-8 or
    UTF-16) and goes; else the charset that the file's CHAR line declares, ANSI as code page 1252; files that declare
    none, or UTF-8 without being it, are UTF-8 where their bytes are that, and code page 1252 where not."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")
    bytes_ = F.decode("content", "ISO-8859-1")
    declared = F.upper(F.regexp_extract(bytes_, r"(?m)^\s*1 CHAR +([A-Za-z0-9-]+)", 1))
    western = F.translate(bytes_, "".join(map(chr, CP1252)), "".join(CP1252.values()))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    mark = F.upper(F.hex(F.substring("content", 1, 2)))
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).when(F.lit(charset == "latin-1") | (declared == "ANSEL"), bytes_)
    text = text.when(declared.isin("ANSI", "CP1252") | ~valid, western).otherwise(F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    rows = files.select("file_id", F.posexplode(F.split(F.regexp_replace(text, "\n\\z", ""), "\n")).alias("n", "raw"))
    return rows.select("file_id", (F.col("n") + 1).cast("long").alias("lineno"), "raw")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, sha256) of each file, for sessions that check their inputs."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), F.sha2("content", 256).alias("sha256"))


def last_in(column: Column, window: WindowSpec | None = None) -> Column:
    """The latest value that is not null, up to this row, in the record."""
    return F.last(column, ignorenulls=True).over((window or by_record()).rowsBetween(W.unboundedPreceding, 0))


def parse_lines(raw: DataFrame) -> DataFrame:
    """raw: (file_id, lineno, raw). Lines outside the grammar have a null level and no record of their own."""
    group = lambda k: F.regexp_extract("raw", GRAMMAR, k)
    rows = raw.select("file_id", "lineno", "raw", group(1).try_cast("int").alias("level"), F.nullif(group(2), F.lit("")).alias("xref"), group(3).alias("tag"), group(4).alias("value"))
    rows = rows.withColumn("rec_no", F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).over(by_file()))
    head = F.col("level") == 0
    rows = rows.withColumn("rec_xref", last_in(F.when(head, F.coalesce("xref", F.lit(""))))).withColumn("rec_tag", last_in(F.when(head, F.col("tag"))))
    rows = rows.withColumn("l1_no", last_in(F.when(F.col("level") == 1, F.col("lineno"))))
    before = by_record().rowsBetween(W.unboundedPreceding, -1)
    level = F.col("level")
    seen = [F.last(F.when(level == k, F.col("lineno")), ignorenulls=True).over(before).alias(f"_{k}") for k in range(SHALLOW)]
    deep = F.collect_list(F.when(level >= SHALLOW, F.struct("lineno", "level"))).over(before).alias("_deep")
    above = F.array_max(F.transform(F.filter("_deep", lambda x: x["level"] < level), lambda x: x["lineno"]))
    parent = F.greatest(*[F.when(level > k, F.col(f"_{k}")) for k in range(SHALLOW)], F.when(level > SHALLOW, above))
    return rows.select("*", *seen, deep).withColumn("parent_lineno", parent).drop("_deep", *[f"_{k}" for k in range(SHALLOW)])


def fold(lines: DataFrame) -> DataFrame:
    """``nodes``: CONT adds a line break and its value to the node before it, CONC its value alone."""
    rows = lines.filter("level is not null")
    more = F.col("tag").isin("CONT", "CONC")
    rows = rows.withColumn("anchor", last_in(F.when(~more, F.col("lineno"))))
    piece = F.when(F.col("tag") == "CONT", F.concat(F.lit("\n"), "value")).otherwise(F.col("value"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", piece.alias("piece")))), lambda x: x["piece"]), "")
    texts = rows.filter("anchor is not null").groupBy("file_id", "rec_no", "anchor").agg(text.alias("value"))
    heads = rows.filter(~more).drop("value", "anchor", "raw")
    keys = ["file_id", "rec_no"]
    return heads.join(texts.withColumnRenamed("anchor", "lineno"), [*keys, "lineno"])


def with_parent(nodes: DataFrame, *columns: str) -> DataFrame:
    """nodes with columns of their parents, as parent_NAME."""
    up = nodes.select("file_id", "rec_no", F.col("lineno").alias("parent_lineno"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return nodes.join(up, ["file_id", "rec_no", "parent_lineno"], "left")


def is_pointer(column: str = "value") -> Column:
    return F.trim(column).rlike(POINTER)


def people(nodes: DataFrame) -> DataFrame:
    """``indi``: a row for each INDI; of repeated xrefs the last counts. names in file order, sex upper-cased."""
    rows = nodes.filter("rec_tag = 'INDI' and level <= 1")
    listed = lambda tag: F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == tag, F.struct("lineno", F.trim("value").alias("v"))))), lambda x: x["v"])
    out = rows.groupBy("file_id", "rec_no", F.col("rec_xref").alias("xref")).agg(
        F.upper(F.trim(F.max_by("value", F.when(F.col("tag") == "SEX", F.col("lineno"))))).alias("sex"), listed("NAME").alias("names"),
        listed("FAMC").alias("famc"), listed("FAMS").alias("fams"), listed("OBJE").alias("media"), listed("NOTE").alias("notes"),
    )
    last = W.partitionBy("file_id", "xref").orderBy(F.col("rec_no").desc())
    return out.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n").withColumnRenamed("rec_no", "ord")


def families(nodes: DataFrame) -> DataFrame:
    """``fam``: the last HUSB and WIFE, the children in order."""
    rows = nodes.filter("rec_tag = 'FAM' and level <= 1")
    last = lambda tag: F.max_by(F.trim("value"), F.when(F.col("tag") == tag, F.col("lineno")))
    chil = F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "CHIL", F.struct("lineno", F.trim("value").alias("v"))))), lambda x: x["v"])
    out = rows.groupBy("file_id", "rec_no", F.col("rec_xref").alias("xref")).agg(last("HUSB").alias("husb"), last("WIFE").alias("wife"), chil.alias("chil"))
    one = W.partitionBy("file_id", "xref").orderBy(F.col("rec_no").desc())
    return out.withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n").withColumnRenamed("rec_no", "ord")


def sources(nodes: DataFrame) -> DataFrame:
    """``sour``: title, author, publisher, repository pointer and REFN of each source record."""
    rows = nodes.filter("rec_tag = 'SOUR' and level <= 1")
    last = lambda tag: F.max_by(F.trim("value"), F.when(F.col("tag") == tag, F.col("lineno")))
    return rows.groupBy("file_id", F.col("rec_no").alias("ord"), F.col("rec_xref").alias("xref")).agg(*[last(t).alias(c) for t, c in (("TITL", "title"), ("AUTH", "author"), ("PUBL", "publisher"), ("REPO", "repo"), ("REFN", "refn"))])


def records(nodes: DataFrame, tag: str, children: dict[str, str]) -> DataFrame:
    """Small records (REPO, OBJE, NOTE): the record's value and the last value of each child tag."""
    rows = nodes.filter((F.col("rec_tag") == tag) & (F.col("level") <= 1))
    last = lambda t: F.max_by(F.trim("value"), F.when(F.col("tag") == t, F.col("lineno")))
    return rows.groupBy("file_id", F.col("rec_no").alias("ord"), F.col("rec_xref").alias("xref")).agg(F.max(F.when(F.col("level") == 0, F.col("value"))).alias("value"), *[last(t).alias(c) for t, c in children.items()])


def events(nodes: DataFrame, tags: tuple[str, ...] = tuple(EVENT_TAGS)) -> DataFrame:
    """``ev``: a row for each level-1 event of a person or family, with its first TYPE, DATE, PLAC, AGE and NOTE."""
    own = nodes.filter((F.col("level") <= 2) & F.col("rec_tag").isin("INDI", "FAM") & F.col("l1_no").isNotNull())
    first = lambda tag: F.min_by(F.trim("value"), F.when((F.col("level") == 2) & (F.col("tag") == tag), F.col("lineno")))
    rows = own.groupBy("file_id", "rec_no", F.col("rec_xref").alias("owner_xref"), F.col("rec_tag").alias("owner_kind"), "l1_no").agg(
        F.max(F.when(F.col("level") == 1, F.col("tag"))).alias("tag"), F.max(F.when(F.col("level") == 1, F.trim("value"))).alias("value"),
        *[first(t).alias(c) for t, c in (("TYPE", "type"), ("DATE", "date_raw"), ("PLAC", "place"), ("AGE", "age"), ("NOTE", "note"), ("ADDR", "addr"))],
    )
    nth = F.row_number().over(W.partitionBy("file_id", "rec_no", "tag").orderBy("l1_no")) - 1
    return rows.filter(F.col("tag").isin(*tags)).withColumn("nth", nth)


def citations(nodes: DataFrame) -> DataFrame:
    """``cit``: a row for each source citation that is a pointer: where it stands, its page and its other children."""
    cited = nodes.filter((F.col("tag") == "SOUR") & (F.col("level") > 0) & is_pointer())
    kids = nodes.select("file_id", "rec_no", F.col("parent_lineno").alias("at"), F.col("tag").alias("kid"), F.col("value").alias("kid_value"), F.col("lineno").alias("kid_no"))
    rows = cited.alias("c").join(kids.alias("k"), (F.col("c.file_id") == F.col("k.file_id")) & (F.col("c.rec_no") == F.col("k.rec_no")) & (F.col("c.lineno") == F.col("k.at")), "left")
    page = F.max_by(F.trim("kid_value"), F.when(F.col("kid") == "PAGE", F.col("kid_no")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kid_no", F.concat_ws(" ", "kid", "kid_value").alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("c.file_id", "c.rec_no", "c.rec_xref", "c.rec_tag", "c.l1_no", "c.lineno", "c.level", F.trim("c.value").alias("source_xref")).agg(page.alias("page"), parts.alias("children"))


def edges(nodes: DataFrame) -> DataFrame:
    """``edge``: (file_id, fam, role, indi) for each HUSB, WIFE and CHIL pointer."""
    rows = nodes.filter((F.col("rec_tag") == "FAM") & (F.col("level") == 1) & F.col("tag").isin("HUSB", "WIFE", "CHIL") & is_pointer())
    return rows.select("file_id", F.col("rec_xref").alias("fam"), F.col("tag").alias("role"), F.trim("value").alias("indi"), F.col("lineno").alias("ord"))


def pointers(nodes: DataFrame) -> DataFrame:
    """Every pointer value: where it is and what it points to."""
    return nodes.filter(is_pointer() & (F.col("level") > 0)).select("file_id", "lineno", "rec_no", "rec_xref", "rec_tag", "level", "tag", F.trim("value").alias("target"))


def definitions(nodes: DataFrame) -> DataFrame:
    return nodes.filter("level = 0 and xref is not null").select("file_id", F.col("xref").alias("target"), F.col("tag").alias("target_tag"), F.col("lineno").alias("target_lineno")).dropDuplicates(["file_id", "target"])


def name_map(nodes: DataFrame) -> DataFrame:
    """xref and first NAME, without slashes."""
    rows = nodes.filter("rec_tag = 'INDI' and level = 1 and tag = 'NAME'")
    return rows.groupBy("file_id", F.col("rec_xref").alias("xref")).agg(F.trim(F.regexp_replace(F.replace(F.min_by("value", "lineno"), F.lit("/"), F.lit("")), " +", " ")).alias("name"))
