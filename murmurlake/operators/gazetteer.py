"""Building term lists from public statistics."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import initials_only, titlecase, whole_number

#: What a term may consist of, and places that are also everyday words or first names.
TERM = r"^[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ\-' ]*$"
STOP_PLACES = ("Bro", "Vi", "Viken", "Bo", "By", "Ed", "Lo", "Näs", "Vik", "Ås", "Hed", "Hov", "Backe", "Sand", "Mon", "Åsa")
#: Words that make no name of a school by themselves.
GENERIC = (
    "anpassad", "anpassade", "kommunal", "kommunala", "fristående", "grundläggande", "gymnasial", "vuxen", "vuxna", "för", "och", "i", "som", "vid", "av", "med", "samt", "den", "det",
    "skola", "skolan", "grundskola", "grundskolan", "grundsärskola", "grundsärskolan", "gymnasieskola", "gymnasieskolan", "gymnasium", "gymnasiet", "förskola", "förskolan",
    "särskola", "särskolan", "särskild", "särskilda", "friskola", "fritidshem", "resursskola", "resursskolan", "vuxenutbildning", "vuxenutbildningen", "komvux", "särvux", "lärvux",
    "sfi", "vux", "im", "ab", "utbildning", "utbildningen", "yrkesutbildning", "yrkesvux", "yrkes", "introduktion", "introduktionsprogram", "introduktionsprogrammet", "inriktning", "ämne",
    "ämnesområde", "undervisning", "undervisningsgrupp", "nivå", "anordnare", "externa", "extern", "enhet", "enheten",
)
#: Under which names the columns of public registers go.
STATUS = ("Status",)
SCHOOL_NAME = ("Skolenhetsnamn", "namn", "name")
PLACE_NAME = ("Tätort", "ortnamn", "namn", "name")
POPULATION = ("Folkmängd", "folkmangd", "befolkning", "invånare", "population")


def column_of(rows: DataFrame, candidates: tuple[str, ...]) -> Column:
    """The first filled column of these names, whatever their case, as text; null for none."""
    own = {c.lower(): c for c in reversed(rows.columns)}
    found = [F.nullif(F.col(f"`{own[n.lower()]}`").cast("string"), F.lit("")) for n in candidates if n.lower() in own]
    return F.coalesce(*found, F.lit(None).cast("string"))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a register's export, as text: JSON (a list, or the first list among an object's values) or CSV with a semicolon or comma,
    whichever the first line has more of. The first line is read by Spark, so the path may be in any store."""
    if path.lower().endswith(".json"):
        raw = spark.read.option("multiLine", True).json(path)
        lists = [f.name for f in raw.schema.fields if f.dataType.typeName() == "array"]
        if not lists:
            return raw
        order = spark.read.text(path, wholetext=True).select(*[F.locate(f'"{n}"', F.col("value")).alias(n) for n in lists]).first()
        first = min(lists, key=lambda n: order[n])
        return raw.select(F.explode(f"`{first}`").alias("_r")).select("_r.*")
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    mark = ";" if line.count(";") >= line.count(",") else ","
    return spark.read.option("header", True).option("sep", mark).option("multiLine", True).option("escape", '"').csv(path)


def read_workbook(spark: SparkSession, path: str, sheet: int = 1, name_pattern: str = r"tätort|ortnamn|\bort\b|namn", count_pattern: str = r"folkmängd|befolkning|invånare|antal|bärare") -> DataFrame:
    """(name, count) of a sheet of an .xlsx file, as text: the first cell of the first 15 rows that matches name_pattern heads the names,
    one that matches count_pattern the counts; rows below it are read. A sheet without a heading is an error."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for data in p["content"]:
                yield pd.DataFrame(name_counts(sheet_rows(bytes(data), sheet), name_pattern, count_pattern), columns=["name", "count"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "name string, count string")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes, sheet: int) -> list[dict[str, str]]:
    """The rows of a workbook's sheet, each from column letters to texts."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
    out = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_MAIN}row"):
        cells = {}
        for c in row.findall(f"{_MAIN}c"):
            value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else c.findtext(f"{_MAIN}v")
            if value:
                cells[re.sub(r"[0-9]", "", c.get("r", ""))] = shared[int(value)] if c.get("t") == "s" else value
        out.append(cells)
    return out


def name_counts(rows: list[dict[str, str]], name_pattern: str, count_pattern: str) -> list[tuple[str, str | None]]:
    name = count = None
    for i, row in enumerate(rows[:15]):
        for column, value in row.items():
            name = column if name is None and re.search(name_pattern, value, re.I) else name
            count = column if re.search(count_pattern, value, re.I) else count
        if name is not None:
            return [(r[name], r.get(count)) for r in rows[i + 1 :] if name in r]
    raise ValueError("no heading for names in the first 15 rows")


def clean_terms(rows: DataFrame, least: int = 500, letters: int = 2) -> DataFrame:
    """(term, count) to distinct title-cased terms with enough bearers, sorted; initials are left out."""
    t = F.trim("term")
    ok = (whole_number(F.col("count").cast("string")) >= least) & (F.length(t) >= letters) & t.rlike(TERM) & ~initials_only(t)
    return rows.where(ok).select(titlecase(t).alias("term")).distinct().orderBy("term")


def both_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sheets (term, count) as one, repeats and all."""
    return first.select("term", "count").unionAll(second.select("term", "count"))


def schools(rows: DataFrame, generic: DataFrame | None = None) -> DataFrame:
    """(term): names of several words, valid and one of them of two letters or more and not generic, of schools that are active or of no
    known status. rows: a register with a name and perhaps a status column; generic (word): other words than GENERIC."""
    status, name = column_of(rows, STATUS), F.trim(column_of(rows, SCHOOL_NAME))
    rows = rows.select(F.coalesce(F.lower(status), F.lit("aktiv")).alias("status"), name.alias("term")).where((F.col("status") == "aktiv") & F.contains("term", F.lit(" ")) & F.col("term").rlike(TERM)).select("term").distinct()
    words = rows.select("term", F.explode(F.split("term", r"\s+")).alias("w")).where(F.length("w") >= 2).select("term", F.lower(F.regexp_replace("w", "^-+|-+$", "")).alias("word"))
    stop = rows.sparkSession.createDataFrame([(w,) for w in GENERIC], "word string") if generic is None else generic.select("word")
    own = words.join(stop, "word", "left_anti").select("term").distinct()
    return own.orderBy("term")


def list_lines(terms: DataFrame, header: list[str]) -> DataFrame:
    """(value) lines of a list file, for write.text in one file: the header, a blank line, sorted terms."""
    spark = terms.sparkSession
    head = spark.createDataFrame([(0, i, x) for i, x in enumerate([*header, ""])], "part int, nth long, value string")
    body = terms.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("nth"), F.col("term").alias("value"))
    return head.unionByName(body).orderBy("part", "nth", "value").select("value")


def localities(rows: DataFrame, municipalities: DataFrame, stop_words: DataFrame, least: int = 5000) -> DataFrame:
    """(name, population): parts of names split at `och` and `med`, of large or unknown places, that are no municipality."""
    n = whole_number(F.col("population").cast("string"))
    parts = rows.where(n.isNull() | (n >= least)).select(F.explode(F.split("name", r"\s+(?:och|med)\s+")).alias("term")).select(F.trim("term").alias("term")).where("term <> ''").distinct()
    return parts.join(municipalities.select("term"), "term", "left_anti").join(stop_words.select("term"), "term", "left_anti").orderBy("term")
