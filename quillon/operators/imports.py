"""Import rules: tolerant chain labels, column mapping by name and content, sheet headers, file issues, inventories, batch records."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import rules, sequences
from quillon.operators.features import infer_column

#: Labels of a chain in record headers; names of columns, as they read without case, white space, underscores and hyphens; words of a sheet's header;
#: the token for what is missing; bounds of an import.
CHAIN_LABELS = {"VH": ("VH", "H", "HC", "HEAVY", "HEAVYCHAIN"), "VL": ("VL", "L", "LC", "LIGHT", "LIGHTCHAIN")}
COLUMN_NAMES = {
    "antibody_id": ("antibodyid", "id", "antibody", "clone", "cloneid", "sample", "sampleid", "antibodynumber", "抗体编号", "抗体id", "样本编号", "克隆编号"),
    "VH": ("vh", "heavy", "heavychain", "heavysequence", "heavychainsequence", "hc", "hchain", "重链", "重链序列", "重链氨基酸序列", "vhsequence"),
    "VL": ("vl", "light", "lightchain", "lightsequence", "lightchainsequence", "lc", "lchain", "轻链", "轻链序列", "轻链氨基酸序列", "vlsequence"),
    "Sequence": ("sequence", "seq", "antibodysequence", "proteinsequence", "aasequence", "aminoacidsequence", "序列", "蛋白序列", "氨基酸序列"),
}
HEADER_WORDS = ("antibody", "heavy", "light", "sequence", "inn")
MISSING = "<MISSING>"
MAX_BYTES, MAX_ROWS, MAX_COLUMNS = 25 << 20, 10_000, 256


def labelled_chains(records: DataFrame, header: str, seq: str, chosen: str | None = None) -> DataFrame:
    """records with antibody_id, chain and status: chains by label (id|label or id_label), else as chosen or inferred; MAPPING_REQUIRED where that fails."""
    token = F.split(F.trim(F.regexp_replace(header, "^>", "")), r"\s+")[0]
    bar = F.locate("|", token)
    tail = F.substring_index(token, "_", -1)
    by_bar = bar > 0
    named = F.when(by_bar, token.substr(bar + 1, F.length(token))).when(token.contains("_"), tail).otherwise("")
    lead = F.when(by_bar, token.substr(F.lit(1), bar - 1)).when(token.contains("_"), token.substr(F.lit(1), F.length(token) - F.length(tail) - 1)).otherwise(token)
    label = F.replace(F.upper(named), F.lit("-"), F.lit("_"))
    known = F.when(label.isin(*CHAIN_LABELS["VH"]), "VH").when(label.isin(*CHAIN_LABELS["VL"]), "VL")
    other = F.lit(chosen) if chosen else F.nullif(sequences.infer_chain(F.col(seq)), F.lit("UNKNOWN"))
    chain = F.coalesce(known, other)
    return records.withColumns({"antibody_id": F.when(known.isNotNull(), lead).otherwise(token), "chain": chain, "status": F.when(chain.isNull(), "MAPPING_REQUIRED").otherwise("OK")})


def plain_name(name: str) -> str:
    return re.sub(r"[\s_-]+", "", unicodedata.normalize("NFKC", name or "").strip().casefold())


def mapping_by_name(columns: list[str]) -> tuple[dict[str, str], list[str]]:
    """Fields with their column, and fields that several columns are named for. A sequence column counts only without a VH column."""
    held = {field: [c for c in columns if plain_name(c) in names] for field, names in COLUMN_NAMES.items()}
    mapping = {f: c[0] for f, c in held.items() if len(c) == 1}
    if "VH" in mapping:
        mapping.pop("Sequence", None)
    return mapping, [f for f, c in held.items() if len(c) > 1]


def map_by_content(rows: DataFrame, order: Column) -> DataFrame:
    """(field, column_name, how): columns by their names, and chains that no name gives by the one column whose sequences vote for them, from one pass over the rows."""
    mapping, several = mapping_by_name(rows.columns)
    found = [(f, c, "name") for f, c in mapping.items()]
    rest = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType) and f.name not in mapping.values()]
    if rest and not ({"VH", "VL"} & set(several)):
        long = rows.select(order.alias("__order"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("seq")) for c in rest])).alias("s")).select("__order", "s.*")
        votes = infer_column(long, "column", F.col("__order"), F.col("seq")).filter("inferred IN ('VH', 'VL')").collect()  # a row a column
        for chain in ("VH", "VL"):
            own = [r["column_name"] for r in votes if r["inferred"] == chain]
            if chain not in mapping and len(own) == 1:
                found.append((chain, own[0], "content"))
    return rows.sparkSession.createDataFrame(found, "field string, column_name string, how string")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def header_row(rows: DataFrame) -> DataFrame:
    """One row: the first source_row with at least two cells that are not blank and a word of a header among them. rows: (source_row, cells)."""
    values = F.filter(F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))), lambda c: c != "")
    joined = F.array_join(values, " ")
    worded = F.array_contains(values, "name") | F.array_contains(values, "id")
    for w in HEADER_WORDS:
        worded = worded | joined.contains(w)
    return rows.filter((F.size(values) >= 2) & worded).agg(F.min("source_row").alias("header_row"))


def sheet_cells(rows: DataFrame, header: int | None = None) -> DataFrame:
    """(source_row, column_name, value) of the rows below the header, at a fixed row or detected; blank rows are left out, columns without a name are numbered."""
    at = rows.sparkSession.range(1).select(F.lit(header).alias("header_row")) if header is not None else header_row(rows)
    names = rows.join(F.broadcast(at), F.col("source_row") == F.col("header_row")).select(F.col("cells").alias("__names"), "header_row")
    below = rows.join(F.broadcast(names), F.col("source_row") > F.col("header_row")).filter(F.exists("cells", lambda c: ~blank(c)))
    cell = below.select("source_row", "__names", F.posexplode("cells").alias("k", "value"))
    name = F.coalesce(F.nullif(F.trim(F.get("__names", F.col("k"))), F.lit("")), F.concat(F.lit("unnamed_"), (F.col("k") + 1).cast("string")))
    return cell.select("source_row", name.alias("column_name"), "value")


def nonblank_rows(rows: DataFrame, column: int) -> DataFrame:
    """source_row of the rows whose cell of that column (from 0) is not blank; the values themselves are not read out."""
    return rows.filter(~blank(F.get("cells", F.lit(column)))).select("source_row")


def file_issues(rows: DataFrame, header: list[str], known: list[str], id_field: str, sequence_field: str | None = None) -> DataFrame:
    """(source_row, field, code, severity): extra columns, cells beyond the header, formulas and errors, and every later occurrence of an id or a sequence."""
    width = len(header)
    cell = lambda name: F.nullif(F.trim(F.get("cells", F.lit(header.index(name)))), F.lit(""))
    extra = [(1, h, "EXTRA_COLUMN", "WARNING") for h in header if h not in known]
    out = rows.sparkSession.createDataFrame(extra, "source_row bigint, field string, code string, severity string")
    beyond = F.exists(F.slice("cells", width + 1, MAX_COLUMNS), lambda c: ~blank(c))
    out = out.unionByName(rows.filter(beyond).select("source_row", F.lit("").alias("field"), F.lit("ROW_WIDTH").alias("code"), F.lit("ERROR").alias("severity")))
    marked = F.filter(F.transform("cells", lambda c, k: F.struct(k.alias("k"), c.alias("c"))), lambda x: x["c"].startswith("=") | x["c"].isin("#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!"))
    formulas = rows.select("source_row", F.explode(marked).alias("m"))
    out = out.unionByName(formulas.select("source_row", (F.col("m.k") + 1).cast("string").alias("field"), F.lit("FORMULA_OR_CELL_ERROR").alias("code"), F.lit("ERROR").alias("severity")))
    for field, code, severity in ((id_field, "DUPLICATE_ID", "ERROR"), (sequence_field, "DUPLICATE_SEQUENCE", "WARNING")):
        if field:
            keyed = rows.select("source_row", cell(field).alias("__v")).filter("__v IS NOT NULL")
            first = keyed.groupBy("__v").agg(F.min("source_row").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
            again = keyed.join(first, "__v").filter("source_row > __first")
            out = out.unionByName(again.select("source_row", F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    return out


def column_inventory(rows: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_present, n_numeric) of every column, from one aggregate."""
    of = lambda c: F.col(c).cast("string")
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~blank(of(c)), 1)).alias("n_present"), F.count(F.when(~blank(of(c)), of(c).try_cast("double"))).alias("n_numeric")) for c in rows.columns]
    return rows.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def label_gate(rows: DataFrame, id_col: str, label: str, n: int) -> DataFrame:
    """One row: whether a label table has n rows, distinct ids, no blank id and finite labels; only these two columns are read."""
    value = F.col(label).cast("string").try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    a = rows.select(id_col, label).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(id_col).alias("n_ids"), F.count(F.when(blank(F.col(id_col).cast("string")), 1)).alias("n_blank_ids"), F.count(F.when(~finite, 1)).alias("n_not_finite"))
    return a.withColumn("ok", (F.col("n_rows") == n) & (F.col("n_ids") == n) & (F.col("n_blank_ids") == 0) & (F.col("n_not_finite") == 0))


def missing_token(value: Column) -> Column:
    """The trimmed text, or one token for null, NaN and blank."""
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), MISSING).otherwise(text)


def batch_records(rows: DataFrame, id_col: str = "antibody_id", row_col: str = "row_id") -> DataFrame:
    """Records of a batch by the rows' own numbers, never by position: a name for blank ids, warnings, and a status that tells them.

    Invalid records come last, others by falling score. rows: row number (from 0), id, VH, VL.
    """
    trimmed = rows.select(F.col(row_col).alias("row_id"), F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("id"), "VH", "VL")
    counts = trimmed.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    summary = rules.batch_summary(trimmed.select(F.col("row_id").alias("k"), "VH", "VL"), "k").withColumn("row_id", F.col("antibody_id").cast("long"))
    j = trimmed.select("row_id", "id").join(counts, "id").join(summary.drop("antibody_id"), "row_id")
    unnamed = F.col("id") == ""
    own = F.array_compact(F.array(F.when(unnamed, "Original antibody ID was blank"), F.when(F.col("n") > 1, "Duplicate antibody ID")))
    status = F.when(F.col("analysis_status") == "success", F.when(F.size(own) > 0, "WARNING").otherwise("SUCCESS")).when(F.col("analysis_status") == "partial_error", "PARTIAL").otherwise("INVALID")
    warnings = F.array_join(F.concat(own, F.when(F.col("warnings") != "", F.array("warnings")).otherwise(F.array().cast("array<string>"))), "; ")
    name = F.when(unnamed, F.format_string("Unnamed-%03d", F.col("row_id") + 1)).otherwise(F.col("id"))
    out = j.select("row_id", name.alias("antibody_id"), "risk_score", "risk_level", status.alias("status"), warnings.alias("warnings"))
    return out.orderBy(F.col("status") == "INVALID", F.desc_nulls_last("risk_score"), "row_id")


def status_counts(records: DataFrame) -> DataFrame:
    """One row of counters of a batch by status."""
    names = ("SUCCESS", "WARNING", "PARTIAL", "INVALID")
    return records.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s.lower()}") for s in names])
