"""Writers: CSV results, immutable artifacts, canonical text, workbooks, reports."""

from __future__ import annotations

import json
import uuid
import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

#: Rows of a workbook's sheet, rows of a report.
SHEET_ROWS, REPORT_ROWS = 1_048_576, 10_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("encoding", "UTF-8").csv(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Parquet that is never overwritten; the commit protocol makes it whole or absent."""
    df.write.mode("errorifexists").parquet(path)


def _write_new(spark: SparkSession, path: str, data: bytes) -> None:
    """Bytes as a new file of the path's store: written beside it, then renamed; an existing file is refused."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{uuid.uuid4().hex}.part"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    out = fs.create(part, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)


def bounded_rows(df: DataFrame, order: list[str], most: int) -> list:
    """All rows in order; a frame of more than `most` is refused, never cut."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def cell_text(value) -> str:
    return "" if value is None else format(value, ".17g") if isinstance(value, float) else str(value)


def write_canonical_csv(df: DataFrame, path: str, order: list[str], most: int = SHEET_ROWS) -> None:
    """One CSV file that is the same for the same rows: ordered, line feeds, floats by 17 digits; never overwritten."""
    quoted = lambda t: '"' + t.replace('"', '""') + '"' if any(c in t for c in '",\n\r') else t
    lines = [",".join(map(quoted, df.columns))] + [",".join(quoted(cell_text(v)) for v in r) for r in bounded_rows(df, order, most)]
    _write_new(df.sparkSession, path, ("\n".join(lines) + "\n").encode())


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of text and number cells."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'

    def name_of(k: int) -> str:
        out = ""
        while k >= 0:
            out, k = chr(65 + k % 26) + out, k // 26 - 1
        return out

    def cell(r: int, k: int, v) -> str:
        at = f"{name_of(k)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f'<c r="{at}"><v>{cell_text(v)}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_xlsx(df: DataFrame, path: str, order: list[str], sheet: str = "results", most: int = SHEET_ROWS - 1) -> None:
    """A new workbook of one sheet with a header, refused beyond the sheet's rows."""
    _write_new(df.sparkSession, path, workbook({sheet: [df.columns, *map(list, bounded_rows(df, order, most))]}))


def write_template(spark: SparkSession, path: str) -> None:
    """A workbook to fill in: the columns that a batch needs, and one example."""
    _write_new(spark, path, workbook({"antibodies": [["antibody_id", "VH", "VL"], ["AB001", "EVQLVESGG", "DIQMTQSPS"]]}))


def markdown_table(df: DataFrame, order: list[str]) -> list[str]:
    """Lines of a Markdown table of a report's few rows."""
    safe = lambda v: cell_text(v).replace("|", "\\|").replace("\n", " ")
    rows = bounded_rows(df, order, REPORT_ROWS)
    return ["| " + " | ".join(map(safe, r)) + " |" for r in ([*df.columns], ["---"] * len(df.columns), *rows)]


def json_report(df: DataFrame, order: list[str]) -> str:
    """A report's few rows as JSON with sorted keys; not-finite numbers become null."""
    finite = lambda v: None if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v
    return json.dumps([{k: finite(v) for k, v in r.asDict().items()} for r in bounded_rows(df, order, REPORT_ROWS)], sort_keys=True, ensure_ascii=False, default=str)
