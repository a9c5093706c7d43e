"""Retrieval, literature and guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators import guards, retrieval
from quillon.plans.registry import Registry
from quillon.plans.views import PAIRS, pairs, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

BL = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@query("chunk_length", f"""WITH d AS (SELECT doc_id, trim(coalesce(text, ''), {BL}) AS s FROM documents),
c AS (SELECT doc_id, k, trim(substr(s, k * 700 + 1, 800), {BL}) AS text FROM (SELECT doc_id, s, unnest(generate_series(0, greatest(0, CAST(ceil((length(s) - 800) / 700::DOUBLE) AS INT)))) AS k FROM d)),
n AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS "index", text FROM c WHERE text <> '')
SELECT doc_id, doc_id || '-c' || "index" AS chunk_id, "index", text FROM n""")
def chunk_length(spark, sf):
    return retrieval.chunk_by_length(table(spark, sf, "documents"), "doc_id", "text")


MARKDOWN = "SELECT doc_id, list_reduce(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN i % 3 = 2 THEN '## ' || x ELSE x END), lambda a, b: a || chr(10) || b) AS t FROM documents"


@query("chunk_heading", f"""WITH m AS ({MARKDOWN}),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM m),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM l),
b AS (SELECT doc_id, CAST(s - 1 AS INT) AS i, trim(string_agg(line, chr(10) ORDER BY n), {BL}) AS body, trim(arg_min(regexp_replace(line, '^#{{1,6}}[ \\t]+', ''), n), {BL}) AS head FROM g WHERE s > 0 GROUP BY doc_id, s),
k AS (SELECT doc_id, i, CASE WHEN head <> '' THEN head || chr(10) || body ELSE body END AS block FROM b
      UNION ALL SELECT doc_id, NULL, t FROM m WHERE doc_id NOT IN (SELECT doc_id FROM b)),
c AS (SELECT doc_id, i, length(block) > 1200 AS long, CASE WHEN i IS NULL OR length(block) > 1200 THEN trim(block, {BL}) ELSE block END AS block FROM k),
p AS (SELECT doc_id, i, long, block, unnest(CASE WHEN i IS NULL OR long THEN generate_series(0, greatest(0, CAST(ceil((length(block) - 1200) / 1100::DOUBLE) AS INT))) ELSE [-1] END) AS w FROM c),
q AS (SELECT doc_id, i, long, w, CASE WHEN w < 0 THEN block ELSE trim(substr(block, w * 1100 + 1, 1200), {BL}) END AS text FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY w) - 1 AS j FROM q WHERE w < 0 OR text <> '')
SELECT doc_id, doc_id || CASE WHEN i IS NULL THEN '-c' || j ELSE '-h' || i || CASE WHEN long THEN '-s' || j ELSE '' END END AS chunk_id, CAST(CASE WHEN i IS NULL THEN j WHEN long THEN i * 1000 + j ELSE i END AS INT) AS "index", text FROM r""")
def chunk_heading(spark, sf):
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("## "), x)).otherwise(x))
    return retrieval.chunk_by_heading(table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("t")), "doc_id", "t")


COS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 50 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c)"""


@query("cosine_topk", f"WITH {COS} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM cr WHERE rank <= 5")
def cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.cosine_top_k(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
BM25 = f"""t AS (SELECT doc_id, {TOK.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
qt AS (SELECT DISTINCT item_id, unnest({TOK.format('text')}) AS term FROM benchmark),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY 1, 2, 3),
dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN dfr USING (term), s GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM b)"""


def bm25_ranked(spark, sf, k):
    b = retrieval.bm25(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")
    return retrieval.top_per(b.withColumn("score", F.round("score", 8)), "item_id", "score", "doc_id", k)


@query("bm25_topk", f"WITH {BM25} SELECT item_id, doc_id, round(round(score, 8), 4) AS score, CAST(rank AS INT) AS rank FROM br WHERE rank <= 5")
def bm25(spark, sf):
    return bm25_ranked(spark, sf, 5).withColumn("score", F.round("score", 4))


GRAMS = """w AS (SELECT item_id, ' ' || unnest(list_filter(string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) || ' ' AS p FROM benchmark),
g AS (SELECT item_id, substr(p, s, n) AS gram FROM (SELECT item_id, p, n, unnest(generate_series(1, length(p) - n + 1)) AS s FROM w, (VALUES (3), (4), (5)) x(n) WHERE length(p) >= n) UNION ALL SELECT item_id, p FROM w WHERE length(p) < 3),
tf AS (SELECT item_id, gram, count(*) AS tf FROM g GROUP BY 1, 2), dfr AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT item_id, gram, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN dfr USING (gram)),
nrm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1), wt AS (SELECT item_id, gram, w / norm AS weight FROM raw JOIN nrm USING (item_id)),
sim AS (SELECT a.item_id AS item_id, b.item_id AS other_id, sum(a.weight * b.weight) AS score FROM wt a JOIN wt b ON a.gram = b.gram AND a.item_id <> b.item_id GROUP BY 1, 2)"""


@query("tfidf_weights", f"WITH {GRAMS} SELECT item_id, count(*) AS n_grams, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest FROM wt GROUP BY item_id")
def tfidf_weights(spark, sf):
    w = retrieval.tfidf(table(spark, sf, "benchmark"), "item_id", "text")
    return w.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


@query("tfidf_topk", f"WITH {GRAMS} SELECT item_id, other_id, round(round(score, 8), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, other_id) AS rank FROM sim) WHERE rank <= 3")
def tfidf_topk(spark, sf):
    w = retrieval.tfidf(table(spark, sf, "benchmark"), "item_id", "text")
    a, b = w.select("item_id", "gram", F.col("weight").alias("x")), w.select(F.col("item_id").alias("other_id"), "gram", F.col("weight").alias("y"))
    s = a.join(b, "gram").filter("item_id <> other_id").groupBy("item_id", "other_id").agg(F.round(F.sum(F.col("x") * F.col("y")), 8).alias("score"))
    return retrieval.top_per(s, "item_id", "score", "other_id", 3).select("item_id", "other_id", F.round("score", 5).alias("score"))


HYBRID = f"""{COS.replace("WHERE q.vec_id % 50 = 0", "WHERE q.vec_id IN (SELECT item_id FROM benchmark)")}, {BM25},
u AS (SELECT query_id AS item_id, id AS doc_id, rank, 0 AS list FROM cr WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, rank, 1 FROM br WHERE rank <= 10),
f AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS seen FROM u GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 10) DESC, seen, doc_id) AS rank FROM f)"""


def hybrid_ranked(spark, sf, k):
    e, b = table(spark, sf, "embeddings"), table(spark, sf, "benchmark")
    vectors = retrieval.cosine_top_k(e, "vec_id", "embedding", e.join(b.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), "vec_id", "embedding", 2 * k)
    vectors = vectors.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank")
    return retrieval.reciprocal_rank_fusion([vectors, bm25_ranked(spark, sf, 2 * k).select("item_id", "doc_id", "rank")], "item_id", "doc_id").filter(F.col("rank") <= k)


@query("rrf_hybrid", f"WITH {HYBRID} SELECT item_id, doc_id, round(score, 8) AS score, CAST(rank AS INT) AS rank FROM fr WHERE rank <= 5")
def hybrid(spark, sf):
    return hybrid_ranked(spark, sf, 5).withColumn("score", F.round("score", 8))


@query("context_assembly", f"""WITH {BM25}, h AS (SELECT item_id, rank, '[' || rank || '] (' || source || ') ' || substr(trim(text, {BL}), 1, 2000) AS block FROM br JOIN documents USING (doc_id) WHERE rank <= 5 AND trim(coalesce(text, ''), {BL}) <> ''),
o AS (SELECT *, sum(length(block)) OVER w > 2000 AND row_number() OVER w > 1 AS over FROM h WINDOW w AS (PARTITION BY item_id ORDER BY rank)), c AS (SELECT *, bool_or(over) OVER (PARTITION BY item_id ORDER BY rank) AS cut FROM o)
SELECT item_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_blocks FROM c WHERE NOT cut GROUP BY item_id""")
def context(spark, sf):
    hits = bm25_ranked(spark, sf, 5).join(table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id")
    return retrieval.assemble_context(hits, "item_id", F.col("text"), F.col("source"), 2000)


TITLE, ABSTRACT = "string_split(coalesce(text, ''), chr(10))[1]", "substr(coalesce(text, ''), length(string_split(coalesce(text, ''), chr(10))[1]) + 1)"
RERANK = f"""q AS (SELECT DISTINCT item_id, unnest({TOK.format('text')}) AS term FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest({TOK.format(TITLE)}) AS term, 3 AS w FROM documents UNION ALL SELECT DISTINCT doc_id, unnest({TOK.format(ABSTRACT)}), 1 FROM documents),
s AS (SELECT item_id, doc_id, CAST(sum(w) AS DOUBLE) AS score FROM q JOIN d USING (term) GROUP BY 1, 2), rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s)"""


def reranked(spark, sf, k):
    text = F.coalesce("text", F.lit(""))
    title = F.split(text, "\n")[0]
    return retrieval.rerank(table(spark, sf, "benchmark").withColumnRenamed("text", "question"), "item_id", "question", table(spark, sf, "documents"), "doc_id", title, text.substr(F.length(title) + 1, F.length(text)), k)


@query("lit_rerank", f"WITH {RERANK} SELECT item_id, doc_id, score, rank FROM rr WHERE rank <= 5")
def lit_rerank(spark, sf):
    return reranked(spark, sf, 5)


@query("lit_hit_mrr", f"WITH {RERANK}, f AS (SELECT item_id, min(rank) FILTER (rank <= 5 AND doc_id % 10 = item_id % 10) AS r FROM rr WHERE rank <= 10 GROUP BY 1) SELECT item_id, CASE WHEN r IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit, round(coalesce(1.0::DOUBLE / r, 0), 6) AS mrr FROM f")
def hit_mrr(spark, sf):
    return retrieval.hit_and_mrr(reranked(spark, sf, 10), "item_id", F.col("doc_id") % 10 == F.col("item_id") % 10, 5)


#: What a turn is about, written into the test texts.
ASPECTS = ("Deamidation of NG@55 in antibody CDR", "isomerization of asp-gly", "methionine oxidation", "glycan profile", "PMID: 1234567 and doi 10.1000/abc")
ASPECT_SQL = "CASE turn % 6 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(ASPECTS)) + " ELSE '' END"
MARKED = f"SELECT conv_id, turn, role, {ASPECT_SQL} || ' ' || text AS text FROM conversations"


def marked(spark, sf):
    aspect = F.element_at(F.array(*[F.lit(a) for a in ASPECTS], F.lit("")), (F.col("turn") % 6 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(aspect, F.lit(" "), "text").alias("text"))


def any_of(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


TOPIC = f"""CASE WHEN regexp_matches(q, '\\bng@?[0-9]') OR {any_of('q', guards.TOPICS['deamidation'])} THEN 'deamidation' WHEN regexp_matches(q, '\\bdg@?[0-9]') OR {any_of('q', guards.TOPICS['isomerization'])} THEN 'isomerization'
 WHEN {any_of('q', guards.TOPICS['oxidation'])} THEN 'oxidation' WHEN {any_of('q', guards.TOPICS['glycosylation'])} THEN 'glycosylation' ELSE 'general' END"""


@query("lit_question_topic", f"SELECT conv_id, turn, {TOPIC} AS topic FROM (SELECT conv_id, turn, lower(text) AS q FROM ({MARKED}))")
def question_topic(spark, sf):
    return marked(spark, sf).select("conv_id", "turn", guards.question_topic(F.col("text")).alias("topic"))


def _relevance_sql(topic: str) -> str:
    others = " OR ".join(any_of("title", t) for o, t in guards.TOPICS.items() if o != topic)
    anti = f"{any_of('title', guards.ANTIBODY)} OR {any_of('abstract', guards.ANTIBODY)}"
    return f"CASE WHEN {any_of('title', guards.TOPICS[topic])} THEN CASE WHEN {anti} THEN 'direct' ELSE 'general' END WHEN {others} THEN 'irrelevant' WHEN {any_of('abstract', guards.TOPICS[topic])} THEN 'general' ELSE 'irrelevant' END"


@query("lit_relevance", f"SELECT conv_id, turn, {_relevance_sql('deamidation')} AS deamidation, {_relevance_sql('oxidation')} AS oxidation FROM (SELECT conv_id, turn, lower(substr(text, 1, 60)) AS title, lower(substr(text, 61)) AS abstract FROM ({MARKED}))")
def relevance(spark, sf):
    title, abstract = F.lower(F.substring("text", 1, 60)), F.lower(F.col("text").substr(F.lit(61), F.length("text")))
    return marked(spark, sf).select("conv_id", "turn", *[guards.relevance(t, title, abstract).alias(t) for t in ("deamidation", "oxidation")])


@query("lit_citations", f"SELECT conv_id, turn, array_to_string(list_distinct(p), ';') AS pmids, array_to_string(list_distinct(d), ';') AS dois, len(list_filter(p, lambda x: x <> '1234567')) = 0 AND len(d) = 0 AS valid FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?i)PMID\\s*:?\\s*([0-9]{{6,9}})', 1) AS p, regexp_extract_all(text, '10\\.[0-9]{{4,9}}/[a-z]+') AS d FROM ({MARKED}))")
def citations(spark, sf):
    return marked(spark, sf).select("conv_id", "turn", *guards.citations(F.col("text"), ["1234567"], []))


@query("lit_rule_query", f"""WITH w AS (SELECT conv_id, turn, lower(text) AS t, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]*'), lambda x: lower(x)) AS w FROM ({MARKED}))
SELECT conv_id, turn, CASE WHEN len(k) = 0 THEN 'antibody' ELSE array_to_string(k, ' ') END AS query FROM (SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(w, lambda x, i: {{'x': x, 'i': i, 'f': list_position(w, x)}}), lambda s: s.i = s.f AND length(s.x) > 2), lambda s: s.x), lambda x: NOT list_contains([{", ".join(f"'{n}'" for n in sorted(guards.NOISE))}], x)) AS k FROM w)""")
def rule_query(spark, sf):
    return marked(spark, sf).select("conv_id", "turn", guards.rule_query(F.col("text")).alias("query"))


@query("guard_numbers", """WITH p AS (SELECT conv_id, turn, role, coalesce(text, '') || ' score ' || (conv_id % 7) || '.5 and ' || (turn * 10) || '%' AS answer, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || CASE WHEN conv_id % 2 = 0 THEN ' ' || (conv_id % 7) || '.5' ELSE '' END AS tool FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(answer, '[0-9]+\\.[0-9]+|[0-9]+(?:\\.[0-9]+)?%'), lambda x: NOT contains(tool, x)), ';') AS violations FROM p WHERE role = 'assistant'""")
def guard_numbers(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" score "), (F.col("conv_id") % 7).cast("string"), F.lit(".5 and "), (F.col("turn") * 10).cast("string"), F.lit("%"))
    extra = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" "), (F.col("conv_id") % 7).cast("string"), F.lit(".5"))).otherwise("")
    tool = F.concat(F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("")), extra)
    return c.select("conv_id", "turn", "role", said.alias("answer"), tool.alias("tool")).filter("role = 'assistant'").select("conv_id", "turn", F.array_join(guards.unsupported_numbers(F.col("answer"), F.col("tool")), ";").alias("violations"))


@query("redact_secrets", """SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)(authorization\\s*:\\s*bearer\\s+|bearer\\s+)[^\\s,;]+', '\\1[REDACTED]', 'g'), '(?i)(api[_ -]?key\\s*[:=]\\s*)[^\\s,;]+', '\\1[REDACTED]', 'g') AS text FROM (SELECT doc_id, replace(replace(text, 'password=', 'api_key='), 'token = ', 'Bearer ') AS t FROM documents)""")
def redact(spark, sf):
    t = F.replace(F.replace("text", F.lit("password="), F.lit("api_key=")), F.lit("token = "), F.lit("Bearer "))
    return table(spark, sf, "documents").select("doc_id", guards.redact_secrets(t).alias("text"))


@query("scrub_sequences", f"WITH {PAIRS} SELECT antibody_id, 'chain ' || CASE WHEN length(VH) >= 20 THEN '[SEQUENCE OMITTED]' ELSE VH END || ' noted' AS text FROM pairs")
def scrub(spark, sf):
    return pairs(spark, sf).select("antibody_id", guards.scrub_text(F.concat(F.lit("chain "), "VH", F.lit(" noted"))).alias("text"))


@query("markdown_plain", """SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{1,6}[ \\t]*', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '`([^`\\n]+)`', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS plain FROM (SELECT conv_id, turn, '## ' || turn || chr(10) || '**' || role || '** `' || conv_id || '` [link](http://x) ' || text AS t FROM conversations)""")
def markdown(spark, sf):
    t = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit("\n**"), "role", F.lit("** `"), F.col("conv_id").cast("string"), F.lit("` [link](http://x) "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", guards.markdown_plain(t).alias("plain"))


ROUTES = {"scan": ("motif", "risk"), "mutation": ("mutation", "n55q"), "literature": ("pmid", "doi", "literature"), "knowledge": ("what", "glycan", "oxid")}


@query("guard_tool_route", f"""SELECT conv_id, turn, array_to_string(list_slice(list_filter([{", ".join(f"CASE WHEN {any_of('lower(text)', v)} THEN '{k}' END" for k, v in ROUTES.items())}], lambda x: x IS NOT NULL), 1, 3), ';') AS tools FROM ({MARKED})""")
def route(spark, sf):
    return marked(spark, sf).select("conv_id", "turn", F.array_join(guards.route_tools(F.col("text"), ROUTES, 3), ";").alias("tools"))
