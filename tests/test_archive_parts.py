from pyspark.sql import functions as F

from strataweave.sources import archive


def test_parts_are_bounded_ordered_and_whole(spark, tmp_path):
    archive.register(spark)
    rows = spark.range(1000).select(F.concat(F.when(F.col("id") % 2 == 0, "Dir/").otherwise("dir/"), F.lpad("id", 5, "0"), F.lit(".txt")).alias("path"), F.repeat(F.lit("x"), 1000).cast("binary").alias("content"))
    folder = str(tmp_path / "parts")
    archive.split(rows, 100_000).write.format("overlay_archive").option("parts", "true").mode("append").save(folder)
    assert not list((tmp_path / "parts").glob(".*"))
    back = spark.read.format("overlay_archive").load(folder)
    assert back.select("path", "content").exceptAll(rows).count() == 0 and back.count() == 1000
    held = back.groupBy("archive").agg(F.sum("logical").alias("n"), F.min(F.lower("path")).alias("low"), F.max(F.lower("path")).alias("high")).orderBy("archive").collect()
    assert len(held) > 5 and max(r.n for r in held) < 300_000
    assert all(a.high < b.low for a, b in zip(held, held[1:]))
