"""Conflicts and agreements of a few keys against the lists of all."""

from pyspark.sql import functions as F

from andamio.functions import specs

NAMES = ["", "10 mm 5 kg", "11 mm 5 kg", "10,0 mm 2 l", "1/2 pulg 20 w", "3/4 pulg 22 w", "0 m 110 v", "2 m 120 v", "#8 12 uds 3 lb", "#9 12 uds 4 lb 500 ml", "0 w 0,5 l"]


def test_conflicts_and_agreements_are_those_listed(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string").select(specs.all_specs(F.col("name")).alias("of"))
    rows = rows.select(F.col("of").alias("a")).crossJoin(rows.select(F.col("of").alias("b"))).withColumn("spec", specs.compare(F.col("a"), F.col("b")))
    every = specs.COMPATIBILITY | specs.SALE_UNIT | specs.PERFORMANCE
    for keys in (specs.COMPATIBILITY | specs.PERFORMANCE, specs.SALE_UNIT - {"volumen_l"}, {"volumen_l"}, every):
        listed = F.array(*map(F.lit, sorted(keys)))
        wrong = rows.filter(
            (specs.conflict(F.col("a"), F.col("b"), keys) != F.arrays_overlap("spec.conflicts", listed)) | (specs.agreement(F.col("a"), F.col("b"), keys) != F.arrays_overlap("spec.agreements", listed))
        )
        assert wrong.count() == 0
    assert rows.filter(specs.conflict(F.col("a"), F.col("b"), every)).count() and rows.filter(specs.agreement(F.col("a"), F.col("b"), every)).count()
