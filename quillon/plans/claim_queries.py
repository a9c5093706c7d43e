"""Claims, private fields, identities of evidence, histories, and parsed literature."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import claims
from quillon.plans.registry import Registry
from quillon.plans.views import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("guard_positions", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(100 + o_orderkey % 50 AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN '' ELSE '55;' || CAST(100 + o_orderkey % 50 AS VARCHAR) END AS violations FROM orders")
def guard_positions(spark, sf):
    k = F.col("o_orderkey")
    p = (100 + k % 50).cast("string")
    answer = F.when(k % 4 == 0, F.concat(F.lit("工具检测到 M@83 与 N"), p, F.lit("\n可能 D99"))).when(k % 4 == 1, F.concat(F.lit("用户给定 NG@"), p, F.lit("-200\nplain N"), p)).when(k % 4 == 2, F.lit("检测到 NS@84-85")).otherwise(F.concat(F.lit("氧化：M"), p, F.lit("\n分析发现 NG@55-56")))
    tool = F.lit("NS@84-85 M@83")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(claims.position_violations(answer, tool).cast("array<string>"), ";").alias("violations"))


@query("guard_length_removal", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'first' || chr(10) || 'sequence length: 120 aa' WHEN 1 THEN 'first' || chr(10) || 'and more' ELSE '序列长度校验失败：最终回答未能保留与工具事实一致的长度声明。' END AS answer FROM orders")
def guard_length_removal(spark, sf):
    k = F.col("o_orderkey") % 3
    answer = F.when(k == 0, "first\nsequence length: 120 aa").when(k == 1, "first\n序列长度为 99 aa; and more").otherwise("Sequence 2 length is 7 aa")
    return table(spark, sf, "orders").select("o_orderkey", claims.without_wrong_lengths(answer, F.array(F.lit(120), F.lit(110))).alias("answer"))


@query("specialist_route", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'scan_agent;ml_agent' WHEN 1 THEN 'knowledge_agent' WHEN 2 THEN 'scan_agent' ELSE 'knowledge_agent' END AS agents FROM conversations")
def specialist_route(spark, sf):
    t = F.col("turn") % 4
    tools = F.when(t == 0, F.array(F.lit("predict_risk"), F.lit("risk_score"))).when(t == 1, F.array(F.lit("rag_search"))).when(t == 2, F.array(F.lit("mutate_scan"))).otherwise(F.array(F.lit("other")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(claims.specialists(tools), ";").alias("agents"))


@query("identity_gaps", """SELECT l_orderkey, l_linenumber, m AS mutation_used, m AND l_linenumber % 2 = 0 AS ml_used,
  concat_ws(';', CASE WHEN l_orderkey % 4 <> 3 AND NOT m THEN 'MUTATION_EXCLUDED' END, CASE WHEN m AND l_linenumber % 2 = 1 THEN 'MUTATION_ML_EXCLUDED' END, CASE WHEN NOT m THEN 'NO_MUTATION' END, CASE WHEN m AND l_linenumber % 2 = 1 THEN 'NO_MUTATION_ML' END) AS gaps
FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 4 = 0 AS m FROM lineitem)""")
def identity_gaps(spark, sf):
    o, n = F.col("l_orderkey") % 4, F.col("l_linenumber")
    lit = F.lit
    e = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", lit("A").alias("antibody_id"), lit("h").alias("vh_hash"), lit("l").alias("vl_hash"), F.when(o == 1, "B").otherwise("A").alias("mutation_antibody_id"),
        lit("vh").alias("mutation_chain"), F.when(o == 2, "l").when(o != 3, "h").alias("original_hash"), lit("m").alias("mutant_hash"), lit("h").alias("baseline_vh_hash"), lit("l").alias("baseline_vl_hash"),
        F.when(n % 2 == 0, "m").otherwise("x").alias("mutant_vh_hash"), lit("l").alias("mutant_vl_hash"), F.struct("l_orderkey", "l_linenumber").alias("k"),
    )
    return claims.identity_gaps(e, "k").select("k.l_orderkey", "k.l_linenumber", "mutation_used", "ml_used", "gaps")


@query("private_fields", """SELECT item_id, '{"note":' || CASE WHEN item_id % 2 = 0 THEN '"[SEQUENCE OMITTED] end"' ELSE '"[LOCAL PATH OMITTED]"' END || ',"rows":[{"n":' || item_id || '},{}],"sequence_hashes":{"VH":"' || sha256(text) || '"}}' AS clean FROM benchmark""")
def private_fields(spark, sf):
    b = table(spark, sf, "benchmark")
    note = F.when(F.col("item_id") % 2 == 0, "ACDEFGHIKLMNPQRSTVWY end").otherwise("/home/user/data")
    nested = F.struct(
        F.lit("k").alias("my_api_key"), F.col("text").alias("VH"), note.alias("note"),
        F.array(F.struct(F.col("item_id").alias("n"), F.lit(None).cast("string").alias("path")), F.struct(F.lit(None).cast("bigint").alias("n"), F.lit("/x").alias("path"))).alias("rows"),
        F.struct(F.sha2("text", 256).alias("VH"), F.lit("short").alias("VL")).alias("sequence_hashes"),
    )
    return b.select("item_id", claims.scrubbed_json(F.to_json(nested)).alias("clean"))


@query("guard_mechanisms", "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'cdr sites reduce binding' WHEN 3 THEN 'motifs may not only alter stability' ELSE '' END AS unsupported FROM conversations")
def guard_mechanisms(spark, sf):
    t = F.col("turn") % 5
    answer = F.when(t == 0, "Fine. CDR sites reduce binding!").when(t == 1, "CDR sites do not reduce binding").when(t == 2, "Liabilities affect stability; ok").when(t == 3, "Motifs may not only alter stability").otherwise("No evidence that motifs alter binding")
    c = table(spark, sf, "conversations")
    found = claims.unsupported_mechanisms(answer, F.lit('{"note": "Liabilities affect: stability"}'), ("cdr", "motif", "liabilit"), ("binding", "stability", "affinity"))
    return c.select("conv_id", "turn", F.array_join(found, ";").alias("unsupported"))


@query("guard_metadata", "SELECT conv_id, turn, CASE turn % 6 WHEN 1 THEN 'rule_result_id' WHEN 3 THEN 'literature_identifiers' WHEN 5 THEN 'sequence_hashes' ELSE '' END AS violations FROM conversations")
def guard_metadata(spark, sf):
    t = F.col("turn") % 6
    answer = F.element_at(F.array(*[F.lit(x) for x in ("rule_result_id is a string", "rule_result_id is null", "literature_identifiers is an empty list", "literature_identifiers is not an array", "sequence_hashes are objects", "sequence_hashes is an empty object")]), (t + 1).cast("int"))
    payload = F.lit('{"rule_result_id": "r1", "literature_identifiers": [], "sequence_hashes": {"VH": "x"}}')
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(claims.metadata_violations(answer, payload, ("rule_result_id", "literature_identifiers", "sequence_hashes")), ";").alias("violations"))


@query("history_state", "SELECT conv_id, turn, CASE WHEN rn <= 4 THEN 'shown' ELSE 'kept' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE rn <= 8")
def history_state(spark, sf):
    return claims.history_state(table(spark, sf, "conversations"), "conv_id", "turn")


def result_text():
    k = F.col("doc_id")
    return F.when(k % 10 == 9, "未检索到 anything").otherwise(F.concat(
        F.lit("[1] Title: Deamidation of "), "source", F.lit("\nPMID: "), (1000000 + k).cast("string"), F.lit("\nDOI: 10.1/a\nJournal: J ("), (1990 + k % 30).cast("string"), F.lit(")\nAbstract: antibody "), "lang",
        F.lit("\n\nnoise\n\n[2] Title: Oxidation\nPMID: 7\nAbstract: none")))


@query("lit_result_entries", """SELECT doc_id, 1 AS "index", 'Deamidation of ' || source AS title, CAST(1000000 + doc_id AS VARCHAR) AS pmid, '10.1/a' AS doi, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, 'antibody ' || coalesce(lang, '') AS abstract FROM documents WHERE doc_id % 10 <> 9 AND lang IS NOT NULL
UNION ALL SELECT doc_id, 2, 'Oxidation', '7', '', '', 'none' FROM documents WHERE doc_id % 10 <> 9 AND lang IS NOT NULL""")
def result_entries(spark, sf):
    d = table(spark, sf, "documents").filter("lang IS NOT NULL")
    return d.select("doc_id", F.explode(claims.result_entries(result_text())).alias("e")).select("doc_id", "e.*")


@query("lit_citation_violations", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '7' ELSE '999999' END AS reference, CASE WHEN doc_id % 10 = 9 OR doc_id % 3 <> 0 THEN 'NOT_RETURNED' ELSE 'IRRELEVANT' END AS why FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT doc_id, CAST(1000000 + doc_id AS VARCHAR), 'NOT_RETURNED' FROM documents WHERE doc_id % 10 = 9 AND lang IS NOT NULL""")
def citation_violations(spark, sf):
    d, k = table(spark, sf, "documents").filter("lang IS NOT NULL"), F.col("doc_id")
    cited = d.select("doc_id", F.array(F.when(k % 3 == 0, "7").otherwise("999999"), (1000000 + k).cast("string")).alias("references"))
    return claims.citation_violations(cited, "doc_id", d.select("doc_id", claims.result_entries(result_text()).alias("entries")), "deamidation")


@query("lit_pubmed_merge", """SELECT 'pubmed:' || c_custkey AS evidence_id, c_name AS title, 'A, B' AS authors, CASE WHEN c_custkey % 2 = 0 THEN 'Long' ELSE 'Short' END AS journal, CAST(1990 + c_custkey % 30 AS INT) AS year, CAST(c_custkey AS VARCHAR) AS pmid,
  CASE c_custkey % 3 WHEN 0 THEN 'PMC5' WHEN 1 THEN 'PMC6' ELSE '' END AS pmcid, '10.1/' || c_custkey AS doi, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Aim & scope ' || c_mktsegment || ' end' END AS abstract, c_custkey % 5 = 0 AS partial FROM customer WHERE c_custkey % 7 <> 0""")
def pubmed_merge(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    ids = F.array(F.struct(F.lit("doi").alias("idtype"), F.concat(F.lit("10.1/"), k.cast("string")).alias("value")), F.when(k % 3 == 0, F.struct(F.lit("pmc").alias("idtype"), F.lit("5").alias("value"))).when(k % 3 == 1, F.struct(F.lit("pmc").alias("idtype"), F.lit("PMC6").alias("value"))))
    authors = F.array(F.struct(F.lit("A").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("B").alias("name")))
    record = F.struct(F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("title"), authors.alias("authors"), F.when(k % 2 == 0, "Long").otherwise("").alias("fulljournalname"), F.lit("Short").alias("source"), F.concat((1990 + k % 30).cast("string"), F.lit(" Mar 3")).alias("pubdate"), F.array_compact(ids).alias("articleids"))
    summaries = c.select(k.cast("string").alias("pmid"), F.to_json(record).alias("json"))
    one = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), k.cast("string"), F.lit("</PMID><Abstract><AbstractText Label='A'>Aim &amp; <i>scope</i></AbstractText><AbstractText>"), "c_mktsegment", F.lit(" end</AbstractText></Abstract></MedlineCitation></PubmedArticle>"))
    sets = c.filter("c_custkey % 5 <> 0").groupBy(F.expr("c_custkey div 20").alias("g")).agg(F.array_join(F.collect_list(one), "").alias("x")).select(F.concat(F.lit("<?xml version='1.0'?><PubmedArticleSet>"), "x", F.lit("</PubmedArticleSet>")).alias("xml"))
    return claims.pubmed_records(summaries, "pmid", "json", claims.pubmed_abstracts(sets, "xml"))


@query("page_sites", "SELECT site, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS site FROM pages) GROUP BY site")
def page_sites(spark, sf):
    return table(spark, sf, "pages").groupBy(claims.site_of(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


@query("order_years", "SELECT year(CAST(o_orderdate AS DATE)) AS year, count(*) AS n FROM orders GROUP BY 1")
def order_years(spark, sf):
    return table(spark, sf, "orders").groupBy(claims.year_of(F.date_format(F.col("o_orderdate").cast("date"), "d MMM yyyy")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("lit_safe_query", "SELECT item_id, 'deamidation asn-gly why is n55 of risky' || CASE WHEN item_id % 2 = 0 THEN ' in cdr2' ELSE '' END AS query FROM benchmark")
def safe_query(spark, sf):
    q = F.concat(F.lit("Why is N55 of ACDEFGHIKLMNPQRSTVWYACDEF risky"), F.when(F.col("item_id") % 2 == 0, " in CDR2").otherwise(" EVQLVES"))
    return table(spark, sf, "benchmark").select("item_id", claims.safe_query(F.lit("deamidation"), F.array(F.lit("asn-gly")), q).alias("query"))
