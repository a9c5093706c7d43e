"""Imports: labels, mappings, headers, issues, inventories, batch records, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import imports, store
from quillon.plans.registry import Registry
from quillon.plans.rule_queries import SUMMARY, VOTED, marked_chains
from quillon.plans.views import PAIRS, pairs, table
from quillon.sources import sinks

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

HEADERS = ("_H", "|LC", "|Heavy-Chain", "", "_x_light", "|VH extra words")
RECORDS = f"""WITH {PAIRS}, n AS (SELECT CAST(antibody_id AS BIGINT) AS n, VH FROM pairs),
r AS (SELECT n, CASE n % 6 WHEN 0 THEN '_H' WHEN 1 THEN '|LC' WHEN 2 THEN '|Heavy-Chain' WHEN 3 THEN '' WHEN 4 THEN '_x_light' ELSE '|VH extra words' END AS label, CASE WHEN n % 2 = 0 THEN 'EVQL' ELSE 'AAAA' END || VH AS seq FROM n),
i AS (SELECT *, length(seq) >= 80 AND seq LIKE 'EVQL%' AND NOT (contains(seq, 'DIQM') AND false) AS heavy FROM r)"""


@query("fasta_tolerant", f"""{RECORDS} SELECT n AS record, CASE n % 6 WHEN 2 THEN n || '|Heavy-Chain' WHEN 3 THEN CAST(n AS VARCHAR) WHEN 4 THEN n || '_x' ELSE CAST(n AS VARCHAR) END AS antibody_id,
  CASE n % 6 WHEN 0 THEN 'VH' WHEN 1 THEN 'VL' WHEN 4 THEN 'VL' WHEN 5 THEN 'VH' ELSE CASE WHEN heavy THEN 'VH' END END AS chain,
  CASE WHEN n % 6 IN (2, 3) AND NOT heavy THEN 'MAPPING_REQUIRED' ELSE 'OK' END AS status FROM i""")
def fasta_tolerant(spark, sf):
    n = F.col("antibody_id").cast("long")
    label = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (n % 6 + 1).cast("int"))
    seq = F.concat(F.when(n % 2 == 0, "EVQL").otherwise("AAAA"), "VH")
    records = pairs(spark, sf).select(n.alias("record"), F.concat(F.lit(">"), "antibody_id", label).alias("header"), seq.alias("seq"))
    return imports.labelled_chains(records, "header", "seq").select("record", "antibody_id", "chain", "status")


@query("map_by_content", f"""{VOTED}, counted AS (SELECT count(*) FILTER (inferred = 'VH') AS h, count(*) FILTER (inferred = 'VL') AS l FROM (SELECT *, row_number() OVER (ORDER BY CAST(antibody_id AS BIGINT)) AS rn FROM i WHERE chain = 'VL') WHERE rn <= 100)
SELECT 'antibody_id' AS field, 'Clone ID' AS column_name, 'name' AS how UNION ALL SELECT 'VH', '重链 序列', 'name'
UNION ALL SELECT 'VL', 'payload', 'content' FROM counted WHERE l > 0 AND l / (h + l) >= 0.9 AND (h + l >= 3 OR h = 0)""")
def map_by_content(spark, sf):
    c = marked_chains(spark, sf).filter("chain <> 'raw'")
    rows = c.groupBy("antibody_id").agg(F.max(F.when(F.col("chain") == "VH", F.col("seq"))).alias("重链 序列"), F.max(F.when(F.col("chain") == "VL", F.col("seq"))).alias("payload"))
    return imports.map_by_content(rows.withColumnRenamed("antibody_id", "Clone ID"), F.col("Clone ID").cast("long"))


SHEET = """s AS (SELECT s_suppkey + 3 AS source_row, [CAST(s_suppkey AS VARCHAR), s_name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END] AS cells FROM supplier WHERE s_suppkey % 10 <> 9
 UNION ALL SELECT s_suppkey + 3, ['', ' ', NULL] FROM supplier WHERE s_suppkey % 10 = 9
 UNION ALL SELECT 0, ['Source: a table', NULL, NULL] UNION ALL SELECT 1, ['note', 'no words', ''] UNION ALL SELECT 2, ['ID', ' Name ', ''])"""


def sheet(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    cells = F.array(k.cast("string"), "s_name", F.when(k % 4 == 0, "").otherwise(F.col("s_nationkey").cast("string")))
    empty = F.array(F.lit(""), F.lit(" "), F.lit(None).cast("string"))
    rows = s.select((k + 3).alias("source_row"), F.when(k % 10 == 9, empty).otherwise(cells).alias("cells"))
    top = spark.createDataFrame([(0, ["Source: a table", None, None]), (1, ["note", "no words", ""]), (2, ["ID", " Name ", ""])], "source_row bigint, cells array<string>")
    return rows.unionByName(top)


CELLS = "SELECT source_row, ['ID', 'Name', 'unnamed_3'][k] AS column_name, cells[k] AS value FROM s, LATERAL (SELECT unnest([1, 2, 3]) AS k) WHERE source_row > {0} AND len(list_filter(cells, lambda c: trim(coalesce(c, '')) <> '')) > 0"


@query("sheet_detected_header", f"WITH {SHEET} {CELLS.format(2)}")
def sheet_detected(spark, sf):
    return imports.sheet_cells(sheet(spark, sf))


@query("sheet_fixed_header", f"WITH {SHEET} {CELLS.format(2)} AND source_row > 2")
def sheet_fixed(spark, sf):
    return imports.sheet_cells(sheet(spark, sf), header=2)


@query("sheet_nonblank_rows", f"WITH {SHEET} SELECT source_row FROM s WHERE trim(coalesce(cells[3], '')) <> ''")
def sheet_nonblank(spark, sf):
    return imports.nonblank_rows(sheet(spark, sf), 2)


@query("import_file_issues", """WITH r AS (SELECT o_orderkey + 2 AS source_row, 'C' || o_custkey AS id, o_orderstatus AS st, o_orderkey % 101 = 0 AS wide, o_orderkey % 103 = 0 AS formula FROM orders),
f AS (SELECT *, min(source_row) OVER (PARTITION BY id) AS first FROM r)
SELECT 1 AS source_row, 'note' AS field, 'EXTRA_COLUMN' AS code, 'WARNING' AS severity UNION ALL SELECT source_row, '', 'ROW_WIDTH', 'ERROR' FROM r WHERE wide
UNION ALL SELECT source_row, '3', 'FORMULA_OR_CELL_ERROR', 'ERROR' FROM r WHERE formula UNION ALL SELECT source_row, 'id', 'DUPLICATE_ID', 'ERROR' FROM f WHERE source_row > first""")
def file_issues(spark, sf):
    k = F.col("o_orderkey")
    note = F.when(k % 103 == 0, "=A1").otherwise("n")
    cells = F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), "o_orderstatus", note, F.when(k % 101 == 0, "beyond").otherwise(" "))
    rows = table(spark, sf, "orders").select((k + 2).alias("source_row"), cells.alias("cells"))
    return imports.file_issues(rows, ["id", "status", "note"], ["id", "status"], "id")


DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@query("column_inventory", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (trim(coalesce(CAST({c} AS VARCHAR), '')) <> '') AS n_present, count(*) FILTER (TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) IS NOT NULL) AS n_numeric FROM labelled" for c in ("doc_id", "lang", "source", "quality")).join(("WITH labelled AS (SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ", "")))
def inventory(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return imports.column_inventory(d.select("doc_id", "lang", "source", "quality"))


@query("label_gate", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (doc_id IS NULL) AS n_blank_ids, count(*) FILTER (quality IS NULL) AS n_not_finite, count(*) = 399 AND count(DISTINCT doc_id) = 399 AND count(quality) = count(*) AS ok FROM labels")
def label_gate(spark, sf):
    return imports.label_gate(table(spark, sf, "labels"), "doc_id", "quality", 399)


@query("missing_token", "SELECT coalesce(nullif(trim(lang), ''), '<MISSING>') AS lang, CASE WHEN l.quality IS NULL THEN '<MISSING>' ELSE CAST(l.quality AS VARCHAR) END AS quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def missing_token(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy(imports.missing_token(F.col("lang")).alias("lang"), imports.missing_token(F.col("quality")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


BATCH = SUMMARY.replace("SELECT antibody_id, CAST(h AS INT) AS VH_length", "SELECT CAST(antibody_id AS BIGINT) AS row_id, CAST(h AS INT) AS VH_length", 1)
RECORDED = f"""WITH b AS ({BATCH}), k AS (SELECT *, CASE WHEN row_id % 9 = 0 THEN '' ELSE 'A' || (row_id % 100000 * 1000 + row_id // 100000 % 77) END AS id FROM b),
d AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM k),
o AS (SELECT row_id, CASE WHEN id = '' THEN 'Unnamed-' || printf('%03d', row_id + 1) ELSE id END AS antibody_id, risk_score, risk_level,
  CASE analysis_status WHEN 'success' THEN CASE WHEN id = '' OR n > 1 THEN 'WARNING' ELSE 'SUCCESS' END WHEN 'partial_error' THEN 'PARTIAL' ELSE 'INVALID' END AS status,
  concat_ws('; ', CASE WHEN id = '' THEN 'Original antibody ID was blank' END, CASE WHEN n > 1 THEN 'Duplicate antibody ID' END, nullif(warnings, '')) AS warnings FROM d)"""


def recorded(spark, sf):
    n = F.col("antibody_id").cast("long")
    name = F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("A"), (n % 100000 * 1000 + F.floor(n / 100000) % 77).cast("string")))
    return imports.batch_records(pairs(spark, sf).select(n.alias("row_id"), name.alias("antibody_id"), "VH", "VL"))


query("batch_records", f"{RECORDED} SELECT * FROM o")(recorded)


@query("batch_status_counts", f"{RECORDED} SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in ("SUCCESS", "WARNING", "PARTIAL", "INVALID")) + " FROM o")
def batch_status(spark, sf):
    return imports.status_counts(recorded(spark, sf))


@query("snapshot_canonical", """SELECT n_nationkey, j AS canonical, to_base64(encode(j)) AS payload, sha256(j) AS payload_sha256 FROM (SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS j FROM nation)""")
def snapshot_canonical(spark, sf):
    n = table(spark, sf, "nation")
    text = n.select("n_nationkey", store.canonical_json(n).alias("canonical"))
    return text.join(store.snapshot(text, "n_nationkey", "canonical"), "n_nationkey")


@query("report_markdown", """WITH a AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT 0 AS line, '| status | orders |' AS text UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY s), '| ' || s || ' | ' || n || ' |' FROM a""")
def report_markdown(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"))
    lines = sinks.markdown_table(a, ["status"])
    return spark.createDataFrame(list(enumerate(lines)), "line bigint, text string")
