from pyspark.sql import functions as F

from linkspark.functions import phonetic


def test_refined_soundex(spark):
    want = {"testing": "T6036084", "The": "T60", "quick": "Q503", "brown": "B1908", "jumped": "J408106", "": "", "12": "", None: None}
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", phonetic.refined_soundex(F.col("w")).alias("x")).collect()
    assert {r.w: r.x for r in got} == want
