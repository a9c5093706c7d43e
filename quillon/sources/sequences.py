"""Readers of sequence tables: CSV, FASTA and XLSX; problems become rows, never exceptions per row."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("antibody_id", "VH", "VL")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """antibody_id (stripped), VH and VL (stripped, upper-cased, null as empty); columns in any order, others dropped, duplicate ids allowed."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = normalized(raw)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def normalized(raw: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return raw.select(text("antibody_id").alias("antibody_id"), F.upper(text("VH")).alias("VH"), F.upper(text("VL")).alias("VL"))


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record (value: header line and sequence lines), split while reading."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    return raw.select(F.regexp_replace("value", r"^>", "").alias("value")).filter(F.trim("value") != "")


def parse_records(records: DataFrame, value: str = "value") -> DataFrame:
    """(antibody_id, chain, sequence, error) of each record. `ID_VH` upper-cases the id, `ID|VH` keeps its case; the chain's case never matters."""
    lines = F.split(F.col(value), r"\r?\n")
    header = F.trim(F.regexp_replace(lines[0], r"^>", ""))
    seq = F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s+", ""))
    pipes = F.split(header, r"\|")
    piped = header.contains("|")
    chain = F.when(piped, F.upper(F.trim(F.element_at(pipes, -1)))).otherwise(F.upper(F.regexp_extract(header, r"(?i)_(VH|VL)$", 1)))
    ident = F.when(piped, F.trim(pipes[0])).otherwise(F.upper(F.regexp_extract(header, r"(?i)^(.*)_(?:VH|VL)$", 1)))
    error: Column = F.when(piped & (F.size(pipes) > 2), "too many header parts").when(~chain.isin("VH", "VL"), "no chain in header").when(F.trim(ident) == "", "blank id").when(seq == "", "empty sequence")
    return records.select(ident.alias("antibody_id"), chain.alias("chain"), seq.alias("sequence"), error.alias("error"))


def pivot_chains(parsed: DataFrame) -> DataFrame:
    """A row per id: VH, VL (missing as empty) and the error of a chain given twice."""
    good = parsed.filter("error IS NULL")
    agg = good.groupBy("antibody_id").pivot("chain", ["VH", "VL"]).agg(F.min("sequence").alias("s"), F.count(F.lit(1)).alias("n"))
    twice = F.when(F.col("VH_n") > 1, "duplicate VH").when(F.col("VL_n") > 1, "duplicate VL")
    return agg.select("antibody_id", F.coalesce("VH_s", F.lit("")).alias("VH"), F.coalesce("VL_s", F.lit("")).alias("VL"), twice.alias("error"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return pivot_chains(parse_records(fasta_records(spark, path)))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for row in ElementTree.fromstring(z.read(names[0])).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = k
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from the first sheets of workbooks, parsed where the files' bytes are; an id given twice is an error of each of its rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*REQUIRED, "error")])

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                rows = sheet_rows(bytes(content))
                head = [str(x or "").strip() for x in rows[0]] if rows else []
                missing = [c for c in REQUIRED if c not in head]
                if missing:
                    yield pd.DataFrame([[None, None, None, f"missing required columns: {', '.join(missing)}"]], columns=schema.names)
                    continue
                at = [head.index(c) for c in REQUIRED]
                body = [[r[k] if k < len(r) else None for k in at] for r in rows[1:] if any(x not in (None, "") for x in r)]
                yield pd.DataFrame([[*r, None] for r in body], columns=schema.names)

    raw = files.mapInPandas(run, schema)
    good = normalized(raw.filter("error IS NULL"))
    n = good.groupBy("antibody_id").count()
    marked = good.join(n, "antibody_id").select(*REQUIRED, F.when(F.col("count") > 1, "duplicate id").alias("error"))
    return marked.unionByName(raw.filter("error IS NOT NULL").select(*schema.names))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """By extension, in any case: .csv, .fasta, .fa, .faa, .xlsx."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "fasta": read_fasta, "fa": read_fasta, "faa": read_fasta, "xlsx": read_xlsx}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind} files")
    return readers[kind](spark, path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_row, cells) of the first sheets of workbooks, rows numbered from 0, for imports.sheet_cells and its like."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("source_row", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))])

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = sheet_rows(bytes(content))
                yield pd.DataFrame({"path": [name] * len(rows), "source_row": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_bounded_csv(spark: SparkSession, path: str, required: list[str]) -> tuple[list[str], DataFrame, int]:
    """(header, rows as (source_row, cells), blank rows) of one strict UTF-8 CSV file within the import's bounds; files beyond them are refused, never cut."""
    import csv
    import io

    from quillon.operators.imports import MAX_BYTES, MAX_COLUMNS, MAX_ROWS

    file = spark.read.format("binaryFile").load(path).select("length", "content").filter(F.col("length") <= MAX_BYTES).head(2)
    if len(file) != 1:
        raise ValueError(f"one file with a header, of at most {MAX_BYTES} bytes, is needed")
    try:
        lines = list(csv.reader(io.StringIO(bytes(file[0]["content"]).decode("utf-8-sig"), newline=""), strict=True))
    except (UnicodeDecodeError, csv.Error) as e:
        raise ValueError(f"not strict UTF-8 CSV: {e}") from e
    header = [h.strip() for h in lines[0]] if lines else []
    if not header or len(header) > MAX_COLUMNS or not all(header) or len(set(header)) < len(header):
        raise ValueError("the header must name up to 256 different columns")
    if missing := sorted(set(required) - set(header)):
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    body = [(k, r) for k, r in enumerate(lines[1:], 2)]
    if len(body) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows")
    full = [(k, r) for k, r in body if any(c != "" for c in r)]
    return header, spark.createDataFrame(full, "source_row bigint, cells array<string>"), len(body) - len(full)


ALIASES = {"antibody_id": ("id", "antibodyid", "name", "antibody"), "VH": ("vh", "heavy", "heavychain", "vhsequence", "hc"), "VL": ("vl", "light", "lightchain", "vlsequence", "lc")}


def map_columns(names: list[str]) -> tuple[dict[str, str], list[str]]:
    """(target -> source column, ambiguous targets), by names without case, blanks, dashes and underscores. A lone sequence column stands for VH."""
    import unicodedata

    plain = {n: re.sub(r"[\s_-]+", "", unicodedata.normalize("NFKC", n).casefold()) for n in names}
    found, ambiguous = {}, []
    for target, words in ALIASES.items():
        hits = [n for n, p in plain.items() if p == target.lower().replace("_", "") or p in words]
        if len(hits) == 1:
            found[target] = hits[0]
        elif hits:
            ambiguous.append(target)
    if "VH" not in found and "VL" not in found:
        lone = [n for n, p in plain.items() if p == "sequence"]
        if len(lone) == 1:
            found["VH"] = lone[0]
    return found, ambiguous


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or several, with a given schema; a document that doesn't parse is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a settings file's lines: comments and lines without a name are left out, `export` and matching quotes go, the last of a name counts."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)  # Spark's readers leave out names that start with a dot
    try:
        lines = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
    line = F.trim("value")
    rows = spark.createDataFrame(list(enumerate(lines)), "at bigint, value string").filter(~line.startswith("#") & line.contains("="))
    name = F.regexp_replace(F.trim(F.substring_index(line, "=", 1)), r"^export\s+", "")
    raw = F.trim(line.substr(F.locate("=", line) + 1, F.length(line)))
    quoted = (F.length(raw) > 1) & raw.substr(1, 1).isin("'", '"') & (raw.substr(1, 1) == raw.substr(-1, 1))
    value = F.when(quoted, raw.substr(F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return rows.select(name.alias("name"), value.alias("value"), "at").filter("name <> ''").groupBy("name").agg(F.max_by("value", "at").alias("value"))
