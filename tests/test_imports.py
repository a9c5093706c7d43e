"""Writers and bounded readers, round trips and refusals."""

import pytest

from quillon.operators import imports
from quillon.sources import sequences, sinks


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "a<b", 0.1), (1, None, 2.0)], "k bigint, name string, x double")
    path = f"{tmp_path}/out.xlsx"
    sinks.write_xlsx(df, path, ["k"])
    rows = {r.source_row: r.cells for r in sequences.read_sheet(spark, path).collect()}
    assert rows[0] == ["k", "name", "x"] and rows[1][0] == "1" and rows[2] == ["2", "a<b", "0.10000000000000001"]
    with pytest.raises(FileExistsError):
        sinks.write_xlsx(df, path, ["k"])
    sinks.write_template(spark, f"{tmp_path}/template.xlsx")
    assert sequences.read_xlsx(spark, f"{tmp_path}/template.xlsx").first().antibody_id == "AB001"
    cells = {(r.source_row, r.column_name): r.value for r in imports.sheet_cells(sequences.read_sheet(spark, path)).collect()}
    assert cells[2, "name"] == "a<b"


def test_canonical_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "x",', 1 / 3), (1, None, 2.0)], "k bigint, t string, x double")
    path = f"{tmp_path}/a.csv"
    sinks.write_canonical_csv(df, path, ["k"])
    assert open(path, newline="").read() == 'k,t,x\n1,,2\n2,"say ""x"",",0.33333333333333331\n'
    with pytest.raises(FileExistsError):
        sinks.write_canonical_csv(df, path, ["k"])
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_canonical_csv(df, f"{tmp_path}/b.csv", ["k"], most=1)
    assert sinks.json_report(df.select("k", "t"), ["k"]) == '[{"k": 1, "t": null}, {"k": 2, "t": "say \\"x\\","}]'


def test_bounded_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿id,x\na,1\n,\n\"b,c\",2,more\n".encode())
    header, rows, blank = sequences.read_bounded_csv(spark, str(path), ["id"])
    assert header == ["id", "x"] and blank == 1 and {r.source_row: r.cells for r in rows.collect()} == {2: ["a", "1"], 4: ["b,c", "2", "more"]}
    assert [r.code for r in imports.file_issues(rows, header, ["id", "x"], "id").collect()] == ["ROW_WIDTH"]
    for bad, why in ((b"id,id\n", "different"), (b"x\n1\n", "required"), (b"\xff\n", "UTF-8"), (b"", "header"), (b"id\n" + b"1\n" * 10_001, "more than")):
        path.write_bytes(bad)
        with pytest.raises(ValueError, match=why):
            sequences.read_bounded_csv(spark, str(path), ["id"])


def test_settings_and_manifests(spark, tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nexport B = 'x=y'\n=z\nA=\"2\"\nC=\n")
    assert {r.name: r.value for r in sequences.read_settings(spark, str(tmp_path / ".env")).collect()} == {"A": "2", "B": "x=y", "C": ""}
    (tmp_path / "m.json").write_text('{"files": [\n{"path": "a"}]}')
    assert sequences.read_manifest(spark, str(tmp_path / "m.json"), "files array<struct<path:string>>").first().files[0].path == "a"
    (tmp_path / "e.csv").write_text("antibody_id,VH,VL\n")
    with pytest.raises(ValueError, match="no rows"):
        sequences.read_csv(spark, str(tmp_path / "e.csv"))


def test_search_strategies(spark):
    from quillon.operators import retrieval

    docs = spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "green pear", [0.0, 1.0]), (3, "blue plum", [0.7, 0.7])], "doc_id int, text string, vector array<double>")
    q = spark.createDataFrame([(9, "apple", [0.0, 1.0])], "query_id int, text string, vector array<double>")
    top = lambda s: [r.id for r in retrieval.search(docs, q, 2, s).orderBy("rank").collect()]
    assert top("keyword") == [1, 2] and top("vector") == [2, 3] and set(top("hybrid")) <= {1, 2, 3}
    with pytest.raises(ValueError):
        top("none")
    near = retrieval.bucketed_neighbours(docs, "doc_id", "vector", q, "query_id", "vector", 1, 1.0).collect()
    assert [r.id for r in near] == [2]


def test_bootstrap_statistics(spark):
    from quillon.operators import stats

    df = spark.createDataFrame([("g", float(k), float(k * k % 7)) for k in range(40)] + [("c", 1.0, 1.0)] * 3, "g string, x double, y double")
    pandas = df.toPandas()
    own = pandas[pandas.g == "g"]
    want = {"pearson": own.x.corr(own.y), "spearman": own.x.rank().corr(own.y.rank())}
    for kind in ("pearson", "spearman", "kendall"):
        r = {x.g: x for x in stats.bootstrap(df, ["g"], "x", "y", resamples=60, statistic=kind).collect()}
        assert r["g"].low <= r["g"].rho <= r["g"].high and r["g"].degenerate == 0 and r["c"].degenerate == 60
        assert kind == "kendall" or abs(r["g"].rho - want[kind]) < 1e-12
