"""Readers, sinks, the append-only store, SQL functions and the stream."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import sql
from quillon.operators import store
from quillon.sources import sequences
from quillon.sources.sinks import write_artifact
from quillon.streaming import batches


def test_csv_fasta_xlsx_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("VL,antibody_id,VH,extra\ndiq, AB1 , evq ,x\n,AB2,AC,\n")
    (tmp_path / "a.fasta").write_text(">ab1_vh\nE\nVQ\n>AB1|VL\nDIQ\n>ab2_VH\nac\n")
    rows = [["antibody_id", "VH", "VL"], ["AB1", "evq", "diq"], ["AB2", "AC", None]]
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v or ""}</t></is></c>' for v in r) + "</row>" for r in rows)
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    want = [("AB1", "EVQ", "DIQ"), ("AB2", "AC", "")]
    for kind in ("csv", "fasta", "xlsx"):
        got = sequences.read_pairs(spark, str(tmp_path / f"a.{kind}"))
        assert sorted((r.antibody_id, r.VH, r.VL) for r in got.collect()) == want, kind
    with pytest.raises(ValueError):
        sequences.read_pairs(spark, "a.txt")


def test_fasta_errors(spark):
    df = spark.createDataFrame([(">a|b|VH\nA",), (">noname\nA",), (">|VL\nA",), (">x_VH\n",), (">Ab|vl\nac",)], "value string")
    got = [(r.antibody_id, r.error) for r in sequences.parse_records(df).collect()]
    assert [e for _, e in got] == ["too many header parts", "no chain in header", "blank id", "empty sequence", None] and got[4][0] == "Ab"


def test_column_mapping():
    assert sequences.map_columns(["Heavy Chain", "light_chain", "Antibody-ID"])[0] == {"VH": "Heavy Chain", "VL": "light_chain", "antibody_id": "Antibody-ID"}
    assert sequences.map_columns(["VH", "heavy"])[1] == ["VH"]


def test_append_only(spark, tmp_path):
    path = str(tmp_path / "entity")
    rules = [("v", "REQUIRED", F.col("v").isNull(), "ERROR")]
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert store.append_batch(frame([("a", 1), ("b", 2)]), path, "k", rules).count() == 0
    assert {r.code for r in store.append_batch(frame([("b", 3), ("c", 4)]), path, "k", rules).collect()} == {"EXISTING_ID"}
    assert {r.code for r in store.append_batch(frame([("d", None), ("e", 1), ("e", 2)]), path, "k", rules).collect()} == {"REQUIRED", "DUPLICATE_ID"}
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        write_artifact(frame([("a", 1)]), path)


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT region_of(55) a, risk_level(59.9D) b, valid_sequence(' ac ') c, valid_sequence('AX') d, (SELECT count(*) FROM scan_sites('NNST')) e").first()
    assert tuple(r) == ("CDR2", "High Risk", True, False, 4)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("antibody_id,VH,VL\nx,NGM,\ny,AAA,M\n")
    sites = batches.stream_sites(spark, str(tmp_path / "in"))
    batches.write_sites(sites, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.antibody_id, r.motif) for r in got) == [("x", "M"), ("x", "NG"), ("y", "M")]
