import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evidenta.operators import evaluation as V
from evidenta.operators import models as M
from evidenta.plans.views import table
from evidenta.sources import files
from evidenta.streaming import events as W


def test_csv_markers_types_and_guard(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1,x,NA\n?,y,2.5\n3,N/A,4\n")
    df = files.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "double"}
    assert sorted((r["b"] or "") for r in df.collect()) == ["", "x", "y"] and df.where("a is null").count() == 1
    with pytest.raises(ValueError):
        files.read_csv(spark, str(path), max_rows=2)


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row><row r="3"><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>'
    strings = f"<sst {ns}><si><t>num</t></si><si><t>name</t></si></sst>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", strings)
    (tmp_path / "t.xlsx").write_bytes(data.getvalue())
    df = files.read_workbook(spark, str(tmp_path / "t.xlsx"))
    assert dict(df.dtypes) == {"num": "double", "name": "string"}
    assert sorted(((r["num"] or 0), r["name"]) for r in df.collect()) == [(0, "name"), (1.5, "x")]


def test_export_escapes_formulas_and_publish_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("plain", 2)], "t string, n int")
    files.export(df.coalesce(1), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    assert "'=1+1" in text and "plain" in text
    files.publish(df, str(tmp_path / "p"))
    files.publish(df.limit(0), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_lessons_and_proofs(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "record_id string, v int")
    files.write_lessons(spark, str(tmp_path / "l"), first)
    files.write_lessons(spark, str(tmp_path / "l"), spark.createDataFrame([("b", 9), ("c", 3)], "record_id string, v int"))
    assert {(r["record_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "l")).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    files.append_proofs(first, str(tmp_path / "j"))
    files.append_proofs(first, str(tmp_path / "j"))
    assert files.read_proofs(spark, str(tmp_path / "j"), "record_id string, v int").count() == 4


def test_search_ranks_by_cosine(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0])], "record_id string, embedding array<double>")
    assert [r["record_id"] for r in V.lesson_search(store, [1.0, 0.1]).collect()] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    e = table(spark, "/root/testdata/sf0.001", "events")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = W.event_stream(spark, str(tmp_path / "in"), e.schema)
    late = W.window_totals(stream, late="60 days")
    query = late.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("windows").collect()) == key(W.window_totals(e).collect())
    W.drain(W.window_totals(W.event_stream(spark, str(tmp_path / "in"), e.schema)), str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert spark.read.schema(late.schema).parquet(str(tmp_path / "out")).count() <= W.window_totals(e).count()


def test_leakage_and_models_on_planted_tables(spark):
    rows = spark.range(300).select(
        F.col("id").alias("row_id"), (F.rand(1) * 10).alias("ad"), (F.randn(2) * 3).alias("foot"), F.when(F.rand(3) < 0.5, "n").otherwise("s").alias("region")
    )
    df = rows.withColumn("sales", 3 * F.col("ad") + F.randn(4)).withColumn("net", F.col("sales") - F.col("foot")).persist()
    out = {r["model"]: r for r in M.driver_regression(df, "sales", ["ad", "foot"], ["region"], "row_id", 3).collect()}
    assert out["ridge"]["r2"] > 0.9 and out["ridge"]["status"] == "ok"
    lint = {(r["feature"], r["kind"]) for r in M.leakage_lint(df, "sales", ["ad", "foot", "net"]).collect()}
    assert ("foot + net", "identity") in lint and not any(f == "ad" for f, _ in lint)
    assert M.driver_regression(df.limit(10), "sales", ["ad"], [], "row_id").first()["status"] == "not_run"


def test_components_threshold_and_rand(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), F.randn(1).alias("f"), (F.rand(2) * 10).alias("x"))
    df = df.withColumn("a", F.col("f") + 0.2 * F.randn(3)).withColumn("b", F.col("f") + 0.2 * F.randn(4)).withColumn("c", F.randn(5))
    kept = [r["kept"] for r in M.components(df, ["a", "b", "c"]).orderBy("component").collect()]
    assert kept == [True, False, False]
    bend = df.withColumn("y", F.greatest(F.col("x") - 5, F.lit(0.0)) * 2 + 0.3 * F.randn(6))
    row = M.threshold_fit(bend, "x", "y", "row_id").first()
    assert abs(row["bend"] - 5) < 0.8 and row["lift"] > 0.05
    same = spark.range(50).select((F.col("id") % 3).alias("a"), (2 - F.col("id") % 3).alias("b"))
    assert M.adjusted_rand(same, "a", "b").first()["ari"] == pytest.approx(1)
    blobs = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3 * 20 + F.randn(7)).alias("p"), (F.col("id") % 3 * -20 + F.randn(8)).alias("q"))
    best = {r["k"]: r for r in M.segments(blobs, ["p", "q"], "row_id", 4, 2).collect()}
    assert best[3]["status"] == "ok"
