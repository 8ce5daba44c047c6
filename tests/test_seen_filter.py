import os

import pytest

from scrivel.operators import crawl
from scrivel.plans import catalogue
from scrivel.sources.tables import table

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_seen_filter_loses_few_urls(spark):
    pages = table(spark, SF, "pages")
    exact = crawl.unseen(pages, pages.where("page_id % 2 = 0").select("url")).count()
    got = catalogue.QUERIES["bloom_dedup"](spark, SF).count()
    print("UNSEEN", got, exact)
    assert 0.98 * exact <= got <= exact
