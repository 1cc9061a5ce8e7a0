from strataweave.operators import units
from strataweave.streaming.watch import watch_donors

KINDS = {"a": "integer", "b": "text"}


def test_batches_of_donors_are_compared(spark, tmp_path):
    schema = "k long, a string, b string"
    base = spark.createDataFrame([(1, "1", "x"), (2, "2", "y"), (3, "3", "z")], schema)
    made = units.plan_units({"k": "integer", **KINDS}, [], "k")
    for n, rows in enumerate([[(1, "9", "x")], [(2, "02", "y"), (4, "4", "w")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        donors = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch_donors(base, donors, "k", made, KINDS, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    found = {(r.k, r.unit_id, r.kind, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(1, "field:a", "FIELD_VALUE", 0), (2, "field:a", "ENCODING_DRIFT", 1)}
