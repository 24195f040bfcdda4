import json

import pytest
from pyspark.sql import functions as F

from brieflake.sources import readers as IO

SCHEMA = "mode string, docket string, llm_model string, replicate int, predicted_winner string"


def _rows(got):
    return sorted(tuple(r) for r in got.select("mode", "docket", "llm_model", "replicate", "predicted_winner").collect())


def test_predictions_round_trip_and_are_replaced_whole(spark, tmp_path):
    rows = [(m, d, f"m{i}", i, "Petitioner") for m in ("x", "y") for d in ("1-1", "2/2 b") for i in range(3)]
    path, pred = str(tmp_path / "p"), spark.createDataFrame(rows, SCHEMA)
    IO.write_predictions(pred, path)
    assert _rows(IO.read_predictions(spark, path, lines=True)) == sorted(rows)
    # a mode that comes again replaces its own, the other stays
    IO.write_predictions(pred.filter("mode = 'x' and replicate = 0"), path)
    assert _rows(IO.read_predictions(spark, path, lines=True)) == sorted(r for r in rows if r[0] == "y" or r[3] == 0)
    many = spark.createDataFrame([("z", "1", "m", i, "Respondent") for i in range(2 * IO.ARRAY_REPLICATES)], SCHEMA)
    IO.write_predictions(many, path)
    assert spark.read.text(path + "/mode=z").count() == 2 and IO.read_predictions(spark, path, lines=True).filter("mode = 'z'").count() == 2 * IO.ARRAY_REPLICATES


def test_predictions_by_docket_are_idempotent(spark, tmp_path):
    rows = [("x", d, "m", i, "Petitioner") for d in ("1-1", "1-2") for i in range(2)]
    path, pred = str(tmp_path / "p"), spark.createDataFrame(rows, SCHEMA)
    for _ in range(2):
        IO.write_predictions(pred, path, folders=True)
    IO.write_predictions(pred.filter("docket = '1-2'").withColumn("predicted_winner", F.lit("Respondent")), path, folders=True)
    assert _rows(IO.read_predictions(spark, path)) == sorted((*r[:4], "Respondent" if r[1] == "1-2" else "Petitioner") for r in rows)
    files = list((tmp_path / "p").glob("mode=*/docket=*/*.txt"))
    assert len(files) == 2 and all(isinstance(json.loads(f.read_text()), list) for f in files)


def test_failed_write_leaves_old_files(spark, tmp_path):
    path = str(tmp_path / "p")
    pred = spark.createDataFrame([("x", str(i), "m", 0, "Petitioner") for i in range(40)], SCHEMA)
    IO.write_predictions(pred, path)
    broken = pred.withColumn("predicted_winner", F.when(F.col("docket") == "33", F.raise_error("no answer").cast("string")).otherwise("Respondent"))
    with pytest.raises(Exception, match="no answer"):
        IO.write_predictions(broken, path)
    got = IO.read_predictions(spark, path, lines=True)
    assert got.count() == 40 and got.filter("predicted_winner <> 'Petitioner'").count() == 0


def test_catalog_of_a_hot_term(spark, tmp_path):
    records = spark.range(500).select(F.when(F.col("id") < 400, 22).otherwise(23).cast("int").alias("term"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("docket"), F.lit('A "b" é').alias("case_name"))
    IO.write_catalog(records, str(tmp_path / "c"), most=50)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert max(len(v) for x in lines for v in x.values()) < 80  # 400 records of one term, in eleven lists
    got = IO.read_catalog(spark, str(tmp_path / "c"), lines=True).select("term", "docket", "case_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, records.collect()))


def test_filings_keep_quotes_and_read_null_as_empty(spark, tmp_path):
    rows = [("Jan 05 2022", 'say "x", y\\', None, "a.pdf", "", "u"), (None, "", "b", "c", "d", "e")]
    IO.write_filings(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in IO.FILING_COLUMNS)), str(tmp_path / "f"))
    got = [tuple(r) for r in IO.read_filings(spark, str(tmp_path / "f")).collect()]
    assert sorted(got) == sorted(tuple(c or "" for c in r) for r in rows)
