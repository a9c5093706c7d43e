"""Published values, edge cases and a second formulation of the rules."""

import random
import re

import pytest

from quillon.functions import rules, sequences
from pyspark.sql import functions as F

# Published example pairs.
L1 = "DIQMTQSPSSLSASVGDRVTITCRASQDVNTAVAWYQQKPGKAPKLLIYSASFLYSGVPSRFSGSRSGTDFTLTISSLQPEDFATYYCQQHYTTPPTFGQGTKVEIK"
EXAMPLES = [
    ("AB001", "EVQLVESGGGLVQPGGSLRLSCAASGFNIKDTYIHWVRQAPGKGLEWVARIYPTNGYTRYADSVKGRFTISADTSKNTAYLQMNSLRAEDTAVYYCSRWGGDGFYAMDYWGQGTLVTVSS", L1, 64.3),
    ("AB006_RISK", "EVQLVESGGGLVQPGGSLRLSCAASGFNIKDTYIHWVRQAPGKGLEWVARIYPTNGYTRYADSVKGRFTISADTSKNTAYLQMNSLRAEDTAVYYCSRNGDGNSDASTDGNGYWGQGTLVTVSS", L1, 48.95),
    ("AB007_BAD", "EVQLVES1GGGLVQ", L1, 96.0),
]


def sites_of(spark, seq, version="overlap_v2"):
    df = spark.createDataFrame([("x", seq, "")], "antibody_id string, VH string, VL string")
    rows = rules.scan_sites(rules.chains(df, "antibody_id"), "antibody_id", version=version).collect()
    return sorted((r.category, r.motif, r.pos_start, r.pos_end, r.region, r.context) for r in rows)


def test_published_scores(spark):
    df = spark.createDataFrame([(i, h, l) for i, h, l, _ in EXAMPLES], "antibody_id string, VH string, VL string")
    got = {r.antibody_id: r for r in rules.batch_summary(df).collect()}
    for i, _, _, score in EXAMPLES:
        assert got[i].risk_score == score
    assert got["AB007_BAD"].analysis_status == "partial_error" and got["AB007_BAD"].risk_level == "Low Risk" and got["AB007_BAD"].VH_length == 14


def test_duplicate_and_null_rows(spark):
    df = spark.createDataFrame([("a", "NNS", None), ("a", "NNS", None), (None, None, ""), ("b", " nng ", "M")], "antibody_id string, VH string, VL string")
    rows = rules.batch_summary(df).collect()
    assert len(rows) == 4
    assert sorted(r.analysis_status for r in rows) == ["error", "partial_error", "partial_error", "success"]
    empty = next(r for r in rows if r.antibody_id == "")
    assert empty.risk_score is None and empty.risk_level == "N/A" and empty.total_risk_count == 0


def test_micro_fixtures(spark):
    assert {(c, m) for c, m, *_ in sites_of(spark, "NNS")} == {("deamidation", "NN"), ("deamidation", "NS"), ("n_glyco", "NNS")}
    assert ("n_glyco", "NST", 7, 9, "FW", "EFGNSTACD") in sites_of(spark, "ACDEFGNSTACDEF")
    assert not [s for s in sites_of(spark, "ACDEFGNPSTACDE") if s[0] == "n_glyco"]
    assert [s[2] for s in sites_of(spark, "AAASSSSSSAAA") if s[0] == "o_glyco"] == [4, 5, 6, 7, 8, 9]
    assert sorted(s[2] for s in sites_of(spark, "SSSPSSS") if s[0] == "o_glyco") == [1, 2, 5, 6, 7]


def by_hand(seq, version):
    out = []
    region = lambda p: next((n for n, a, b in sequences.REGIONS if a <= p <= b), "FW")
    for m, c, _ in rules.CATALOGUE:
        out += [(c, m, k.start() + 1, k.start() + len(m), region(k.start() + 1)) for k in re.finditer(f"(?={m})", seq)]
    pattern = "N[^P][ST]" if version == "frozen_v1" else "(?=(N[^P][ST]))"
    out += [("n_glyco", seq[k.start() : k.start() + 3], k.start() + 1, k.start() + 3, region(k.start() + 1)) for k in re.finditer(pattern, seq)]
    for p in range(len(seq)):
        if seq[p] in "ST" and seq[p + 1 : p + 2] != "P" and any(sum(x in "ST" for x in seq[w : w + 7]) >= 6 for w in range(max(0, p - 6), min(p, len(seq) - 7) + 1)):
            out.append(("o_glyco", seq[p], p + 1, p + 1, region(p + 1)))
    return sorted(out)


@pytest.mark.parametrize("version", rules.VERSIONS)
def test_two_formulations(spark, version):
    rng = random.Random(5)
    seqs = ["NNST", "NNNTT", "NPNST", "STSTSTS", "NGNSNNDGDSDAM"] + ["".join(rng.choice("NSTPGDAMK") for _ in range(rng.randint(1, 150))) for _ in range(60)]
    df = spark.createDataFrame([(str(k), s, "") for k, s in enumerate(seqs)], "antibody_id string, VH string, VL string")
    rows = rules.scan_sites(rules.chains(df, "antibody_id"), "antibody_id", version=version).collect()
    got = {}
    for r in rows:
        got.setdefault(int(r.antibody_id), []).append((r.category, r.motif, r.pos_start, r.pos_end, r.region))
    for k, s in enumerate(seqs):
        assert sorted(got.get(k, [])) == by_hand(s, version), s


def test_validation_order(spark):
    cases = [("", "sequence is empty"), (" é1 ", "sequence has non-ASCII characters"), ("A1", "sequence has non-letter characters"), ("ABZXA", "sequence has non-standard residues: BXZ"), (" ac ", None), (None, "sequence is empty")]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, s string")
    got = {r.k: r.e for r in df.select("k", sequences.validation_error(F.col("s")).alias("e")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1] for c in cases]


def test_sql_functions(spark):
    from pyspark.sql import functions as F

    from quillon.functions import rules, sequences, sql

    sql.register(spark)
    heavy, light = "EVQL" + "A" * 80, "DIQM" + "A" * 80
    rows = spark.createDataFrame([(heavy,), (light,), ("EVQL",), (None,), (heavy.lower() + " ",), ("A" * 90,)], "s string")
    for r in rows.select(F.expr("infer_chain(s)").alias("a"), sequences.infer_chain(F.col("s")).alias("b")).collect():
        assert r.a == r.b
    text = "MNGSNNTADGSSSSSSSPTNATNAT" * 5
    for version in rules.VERSIONS:
        got = spark.sql(f"SELECT * FROM scan_sites('{text}', '{version}')").collect()
        pairs = spark.createDataFrame([(1, text, "")], "k int, VH string, VL string")
        want = rules.scan_sites(rules.chains(pairs, "k"), "k", version=version).select("motif", "category", "pos_start", "pos_end", "region", "context").collect()
        assert sorted(got) == sorted(want) and {r.category for r in got} == set(rules.CATEGORY_OF)
