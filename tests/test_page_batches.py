import pytest
from pyspark.sql import functions as F

from scrivel.functions import web

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("clean", [web.sanitize_html, web.sanitize_css])
def test_workers_get_few_pages_at_once(spark, clean):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "10000")
    try:
        pages = spark.range(0, 1200, 1, 1).select(F.col("id"), clean(F.lit("http://a.b/"), F.repeat(F.lit("<p>x"), 200)).alias("c"))
        assert len(pages.collect()) == 1200 and int(spark.conf.get(KEY)) <= 500
        spark.conf.set(KEY, "70")  # a session's own setting stays
        clean(F.lit(""), F.lit(""))
        assert spark.conf.get(KEY) == "70"
    finally:
        spark.conf.set(KEY, before)
