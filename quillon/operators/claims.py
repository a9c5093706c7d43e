"""Claims in answers, checked against tools and summaries; identities of evidence; private fields; parts of literature results."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import guards

#: Words by which a line claims a tool's finding, or softens it; how risk lines begin; tools of the specialists.
CLAIM_WORDS = ("工具检测到", "工具识别", "工具返回", "工具结果显示", "工具检测", "rule_based", "检测到", "分析发现", "识别为", "被工具")
SOFT_WORDS = ("未检测到", "工具未返回", "工具未检测", "未识别", "未经工具验证", "用户给定", "未确认", "假设", "如果", "可能", "推测")
RISK_LINES = ("脱酰胺化", "异构化", "氧化", "N-糖基化", "O-糖基化", "糖基化", "修饰")
SPECIALISTS = {"scan_agent": ("scan_antibody", "mutate_scan", "risk_score"), "ml_agent": ("predict_risk",), "knowledge_agent": ("rag_search", "literature_search")}
FAILED = ("未检索到", "错误", "检索失败")
#: Fields that never leave the machine.
PRIVATE = ("sequence", "vh", "vl", "raw_sequence", "original_sequence", "mutant_sequence", "path", "file_path", "api_key", "token", "secret", "password")
#: The form of a length claim; words that deny a mechanism, and those that take the denial back.
LENGTH = r"(?i)(?:序列(?:\s*\d+)?长度|sequence(?:\s*\d+)?\s+length)\s*(?:为|is)?\s*[:：]?\s*(\d+)\s*aa\b"
DENIED, STRESSED = r"\b(?:not|never|cannot)\b|未|不能|无法|不应", r"\bnot only\b|不仅"
#: The form of a search result's entries.
ENTRY = {"head": r"^\[\d+\]\s*Title:\s*\S", "index": r"^\[(\d+)\]", "title": r"^\[\d+\]\s*Title:\s*([^\n]+)", "pmid": r"PMID:\s*([0-9A-Za-z]+)", "doi": r"DOI:\s*(\S+)", "year": r"Journal:[^\n]*?\((\d{4})\)", "abstract": r"(?s)Abstract:\s*(.*)"}


def positions(text: Column) -> Column:
    """Distinct start positions of sites that a text names: NG@55-56, M@83, N55."""
    t = F.coalesce(text, F.lit(""))
    at = F.regexp_extract_all(t, F.lit(r"[A-Z]{1,3}@(\d+)"), F.lit(1))
    bare = F.regexp_extract_all(t, F.lit(r"\b[A-Z](\d{2,3})\b(?!@)"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(at, bare), lambda x: x.cast("int")))


def position_violations(answer: Column, tool_text: Column) -> Column:
    """Sorted positions that some line claims as a tool's finding, without softening it, and that the tools did not return; who named them doesn't matter."""
    known = positions(tool_text)
    has = lambda line, words: reduce(lambda a, b: a | b, [line.contains(w) for w in words])
    starts = lambda line: reduce(lambda a, b: a | b, [line.startswith(w) for w in RISK_LINES])
    claimed = F.filter(F.split(F.coalesce(answer, F.lit("")), r"\R"), lambda x: (has(x, CLAIM_WORDS) | starts(x)) & ~has(x, SOFT_WORDS))
    return F.array_sort(F.array_except(F.array_distinct(F.flatten(F.transform(claimed, positions))), known))


def length_values(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LENGTH), F.lit(1)), lambda x: x.cast("int"))


def without_wrong_lengths(answer: Column, known: Column) -> Column:
    """The answer without length claims that aren't among the known lengths; a line that holds nothing else goes, and a notice stands for an answer left empty."""
    wrong = lambda x: (F.size(length_values(x)) > 0) & ~F.coalesce(F.array_contains(known, F.get(length_values(x), F.lit(0))), F.lit(False))
    cleaned = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.when(wrong(x), F.regexp_replace(F.regexp_replace(x, LENGTH, ""), r"^[ ;；,，]+|[ ;；,，]+$", "")).otherwise(x))
    kept = F.zip_with(cleaned, F.split(F.coalesce(answer, F.lit("")), "\n"), lambda c, x: F.when((c == "") & wrong(x), None).otherwise(c))
    text = F.trim(F.array_join(kept, "\n"))
    return F.when(text == "", "序列长度校验失败：最终回答未能保留与工具事实一致的长度声明。").otherwise(text)


def specialists(tools: Column) -> Column:
    """Agents whose tools a plan calls, in a fixed order; the knowledge agent where there are none."""
    active = F.array_compact(F.array(*[F.when(F.arrays_overlap(tools, F.array(*[F.lit(t) for t in own])), F.lit(name)) for name, own in SPECIALISTS.items()]))
    return F.when(F.size(active) > 0, active).otherwise(F.array(F.lit("knowledge_agent")))


def identity_gaps(evidence: DataFrame, id_col: str) -> DataFrame:
    """(id, mutation_used, ml_used, gaps): mutation evidence counts only for the analysed chain and antibody, its model comparison only for exactly these sequences.

    evidence: antibody_id, vh_hash, vl_hash, mutation_antibody_id, mutation_chain, original_hash, mutant_hash, and baseline_vh_hash, baseline_vl_hash, mutant_vh_hash,
    mutant_vl_hash of the model comparison; null where there is none.
    """
    c = F.col
    chain = F.upper(c("mutation_chain"))
    mutated = c("original_hash").isNotNull()
    on_chain = F.when(chain == "VH", c("original_hash") == c("vh_hash")).when(chain == "VL", c("original_hash") == c("vl_hash")).otherwise((c("original_hash") == c("vh_hash")) | (c("original_hash") == c("vl_hash")))
    same_id = c("antibody_id").isNull() | c("mutation_antibody_id").isNull() | (c("antibody_id") == c("mutation_antibody_id"))
    uses = F.coalesce(mutated & on_chain & same_id, F.lit(False))
    compared = c("baseline_vh_hash").isNotNull() | c("baseline_vl_hash").isNotNull()
    base = (c("baseline_vh_hash") == c("vh_hash")) & (c("baseline_vl_hash") == c("vl_hash"))
    new = F.when(chain == "VH", (c("mutant_vh_hash") == c("mutant_hash")) & (c("mutant_vl_hash") == c("vl_hash"))).when(chain == "VL", (c("mutant_vl_hash") == c("mutant_hash")) & (c("mutant_vh_hash") == c("vh_hash")))
    ml = F.coalesce(uses & compared & base & new, F.lit(False))
    gaps = F.array_compact(F.array(F.when(mutated & ~uses, "MUTATION_EXCLUDED"), F.when(uses & compared & ~ml, "MUTATION_ML_EXCLUDED"), F.when(~uses, "NO_MUTATION"), F.when(uses & ~ml, "NO_MUTATION_ML")))
    return evidence.select(id_col, uses.alias("mutation_used"), ml.alias("ml_used"), F.array_join(gaps, ";").alias("gaps"))


def scrub_value(value, key: str = ""):
    """A nested value without private fields; of sequence hashes only digests stay; paths and residue runs in texts are hidden."""
    name = key.casefold().replace("-", "_")
    if name == "sequence_hashes":
        held = value if isinstance(value, dict) else {}
        return {k: v for k, v in held.items() if isinstance(v, str) and len(v) == 64 and all(c in "0123456789abcdefABCDEF" for c in v)}
    if name in PRIVATE or name.endswith("_api_key"):
        return None
    if isinstance(value, dict):
        return {k: s for k, v in value.items() if (s := scrub_value(v, k)) is not None}
    if isinstance(value, list):
        return [scrub_value(v, key) for v in value]
    if isinstance(value, str):
        lead = value.strip()
        drive = len(lead) > 2 and lead[0].isascii() and lead[0].isalpha() and lead[1] == ":" and lead[2] in "\\/"
        return "[LOCAL PATH OMITTED]" if drive or lead.startswith(("\\\\", "/etc/", "/Users/", "/home/")) else guards.hide_sequences(value)
    return value


@F.pandas_udf(T.StringType())
def scrubbed_json(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else json.dumps(scrub_value(json.loads(t)), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for t in text], dtype=object)


def plain_words(text: Column) -> Column:
    """Lower-cased words with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def unsupported_mechanisms(answer: Column, evidence: Column, subjects: tuple[str, ...], effects: tuple[str, ...]) -> Column:
    """Clauses that link a subject with an effect, are not denied, and do not occur word by word in the evidence."""
    source = plain_words(evidence)
    clauses = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"[.!?;\n。！？；]"), plain_words), lambda x: x != "")
    linked = lambda x: reduce(lambda a, b: a | b, [x.contains(s) for s in subjects]) & reduce(lambda a, b: a | b, [x.contains(s) for s in effects])
    denied = lambda x: (x.rlike(DENIED) & ~x.rlike(STRESSED)) | x.rlike(r"^no evidence (?:that|of)\b|^无证据")
    return F.filter(clauses, lambda x: linked(x) & ~denied(x) & ~source.contains(x))


#: Words of a claim about a field's type, and the type that they mean.
TYPE_WORDS = {"string": "string", "strings": "string", "字符串": "string", "list": "array", "lists": "array", "array": "array", "arrays": "array", "列表": "array", "数组": "array", "object": "object", "objects": "object", "dict": "object", "dictionary": "object", "对象": "object", "字典": "object", "null": "null", "none": "null"}


def metadata_violations(answer: Column, payload: Column, fields: tuple[str, ...]) -> Column:
    """Fields of a JSON payload whose claimed type or emptiness (`x is an empty list`, `x is not null`) is not the actual one; fields that it hasn't are violations."""

    def one(field: str) -> Column:
        words = "|".join(sorted(TYPE_WORDS, key=len, reverse=True))
        form = rf"(?i)\b{field}\s*(?:is|are|均为|是|为|[:=])\s*(not\s+)?(?:an?\s+)?(empty\s+|空)?({words})"
        said = F.lower(F.regexp_extract(answer, form, 3))
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_WORDS.items() for x in pair]), said)
        raw = F.get_json_object(payload, f"$.{field}")
        there = F.array_contains(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), field)
        quoted = payload.rlike(rf'"{field}"\s*:\s*"')
        actual = F.when(~there, "missing").when(quoted, "string").when(raw.isNull(), "null").when(raw.startswith("["), "array").when(raw.startswith("{"), "object").otherwise("other")
        empty = F.when(quoted, raw == "").otherwise(raw.rlike(r"^(?:\[\s*\]|\{\s*\})$"))
        match = (actual == kind) & ((F.regexp_extract(answer, form, 2) == "") | F.coalesce(empty, F.lit(False)))
        right = F.when(F.regexp_extract(answer, form, 1) != "", ~match).otherwise(match) & there
        return F.when((said != "") & ~F.coalesce(right, F.lit(False)), F.lit(field))

    return F.array_compact(F.array(*[one(f) for f in fields]))


def history_state(rows: DataFrame, conversation: str, turn: str, shown: int = 4, kept: int = 8) -> DataFrame:
    """(conversation, turn, state) of the last turns: those that are shown and those that are only kept; earlier ones are gone. Found by the last turn numbers, no long window."""
    last = rows.groupBy(conversation).agg(F.slice(F.sort_array(F.collect_set(turn), asc=False), 1, kept).alias("__t"))  # a conversation's turns bound it
    out = last.select(conversation, F.posexplode("__t").alias("__k", turn))
    return out.select(conversation, turn, F.when(F.col("__k") < shown, "shown").otherwise("kept").alias("state"))


# ---- literature


def result_entries(text: Column) -> Column:
    """Entries (index, title, pmid, doi, year, abstract) of a search result's blocks; none of a failed search."""
    t = F.trim(F.coalesce(text, F.lit("")))
    get = lambda b, part: F.trim(F.regexp_extract(b, ENTRY[part], 1))
    blocks = F.filter(F.split(t, r"\n\s*\n"), lambda b: b.rlike(ENTRY["head"]))
    entry = lambda b: F.struct(get(b, "index").cast("int").alias("index"), *[get(b, p).alias(p) for p in ("title", "pmid", "doi", "year", "abstract")])
    failed = reduce(lambda a, b: a | b, [t.startswith(x) for x in FAILED]) | (t == "")
    return F.when(failed, F.array().cast("array<struct<index:int,title:string,pmid:string,doi:string,year:string,abstract:string>>")).otherwise(F.transform(blocks, entry))


def citation_violations(cited: DataFrame, id_col: str, returned: DataFrame, topic: str) -> DataFrame:
    """(id, reference, why) of cited references that a search did not return (NOT_RETURNED) or that are off the topic (IRRELEVANT). cited: id, references; returned: id, entries."""
    entry = returned.select(id_col, F.explode("entries").alias("e"))
    rated = entry.select(id_col, guards.relevance(topic, F.lower("e.title"), F.lower("e.abstract")).alias("relevance"), F.explode(F.array("e.pmid", "e.doi")).alias("reference")).filter("reference <> ''")
    best = rated.groupBy(id_col, "reference").agg(F.max_by("relevance", F.col("relevance") != "irrelevant").alias("relevance"))
    named = cited.select(id_col, F.explode("references").alias("reference")).distinct()
    j = named.join(best, [id_col, "reference"], "left")
    return j.filter("relevance IS NULL OR relevance = 'irrelevant'").select(id_col, "reference", F.when(F.col("relevance").isNull(), "NOT_RETURNED").otherwise("IRRELEVANT").alias("why"))


SUMMARY = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))), T.StructField("fulljournalname", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("pubdate", T.StringType()), T.StructField("articleids", T.ArrayType(T.StructType([T.StructField("idtype", T.StringType()), T.StructField("value", T.StringType())]))),
])


def year_of(text: Column) -> Column:
    """The first four-digit year of a date's text."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<!\d)((?:1[89]|20)\d\d)(?!\d)", 1), F.lit("")).cast("int")


def pubmed_abstracts(xml: DataFrame, xml_col: str) -> DataFrame:
    """(pmid, abstract) of the articles in fetched XML documents: an article's first PMID, its abstract's parts joined by a blank."""
    articles = xml.select(F.explode(F.expr(f"sequence(1, greatest(int(xpath_number({xml_col}, 'count(//PubmedArticle)')), 1))")).alias("k"), F.col(xml_col).alias("x"))
    pmid = F.expr("xpath(x, '//PubmedArticle/MedlineCitation/PMID/text()')")
    parts = F.split(F.regexp_replace("x", r"(?s)^.*?(?=<PubmedArticle[ >])", ""), r"(?=<PubmedArticle[ >])")
    own = articles.select("k", F.get(parts, F.col("k") - 1).alias("article"), F.get(pmid, F.col("k") - 1).alias("pmid"))
    texts = F.regexp_extract_all("article", F.lit(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), F.lit(1))
    plain = F.transform(texts, lambda t: F.trim(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")), F.regexp_replace(t, "<[^>]*>", ""))))
    return own.filter("pmid IS NOT NULL").select("pmid", F.array_join(F.filter(plain, lambda t: t != ""), " ").alias("abstract"))


def pubmed_records(summaries: DataFrame, pmid: str, json_col: str, abstracts: DataFrame) -> DataFrame:
    """Evidence records of summaries (JSON) merged with abstracts by PMID; a record without its title, abstract or PMID is partial, one without a title is left out."""
    r = summaries.select(F.col(pmid).alias("pmid"), F.from_json(json_col, SUMMARY).alias("r")).join(abstracts, "pmid", "left")
    value = lambda kind: F.get(F.transform(F.filter("r.articleids", lambda a: a["idtype"] == kind), lambda a: a["value"]), F.lit(0))
    pmc = F.coalesce(value("pmc"), F.lit(""))
    title, abstract = F.trim(F.coalesce("r.title", F.lit(""))), F.coalesce("abstract", F.lit(""))
    names = F.filter(F.transform("r.authors", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    out = r.select(
        F.concat(F.lit("pubmed:"), "pmid").alias("evidence_id"), title.alias("title"), F.array_join(F.coalesce(names, F.array().cast("array<string>")), ", ").alias("authors"),
        F.trim(F.coalesce(F.nullif(F.col("r.fulljournalname"), F.lit("")), "r.source", F.lit(""))).alias("journal"), year_of(F.col("r.pubdate")).alias("year"), "pmid",
        F.when(pmc == "", "").when(pmc.startswith("PMC"), pmc).otherwise(F.concat(F.lit("PMC"), pmc)).alias("pmcid"), F.coalesce(value("doi"), F.lit("")).alias("doi"), abstract.alias("abstract"),
        ((title == "") | (abstract == "") | (F.col("pmid") == "")).alias("partial"),
    )
    return out.filter("title <> ''")


def site_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without a leading www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def safe_query(topic: Column, terms: Column, question: Column) -> Column:
    """A literature query of the topic, known terms and the question's words, without sequences: residue runs and words of five residues in capitals are left out."""
    words = F.filter(F.split(guards.scrub_text(F.coalesce(question, F.lit(""))), r"[^\p{L}\p{N}-]+"), lambda w: (w != "") & ~w.rlike("^[ACDEFGHIKLMNPQRSTVWY]{5,}$") & ~w.isin("SEQUENCE", "OMITTED"))
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(topic), terms, F.transform(words, F.lower)), lambda w: F.coalesce(w, F.lit("")) != "")), " ")


