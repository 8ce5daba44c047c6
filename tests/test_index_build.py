import glob

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from scrivel.operators import index
from scrivel.plans import catalogue

PAGES = 64


def one_row_group(folder):
    html = [f"<title>t{k}</title><p>ab{k % 7} 中国 abab</p>" for k in range(PAGES)]
    table = pa.table({"page_id": pa.array(range(PAGES), pa.int64()), "url": ["http://a.net/"] * PAGES, "html": html})
    pq.write_table(table, f"{folder}/pages.parquet", row_group_size=PAGES)
    return str(folder)


def test_pages_of_one_row_group_are_spread_before_they_are_parsed(spark, tmp_path):
    docs = catalogue.docs_of(spark, one_row_group(tmp_path), 4)
    sizes = [r.n for r in docs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and sum(sizes) == PAGES  # one task parsed them all
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("Exchange")  # plans are printed from their ends


def test_written_postings_are_packed_and_their_sizes_counted(spark, tmp_path):
    docs = catalogue.docs_of(spark, one_row_group(tmp_path), 4)
    path = f"file://{tmp_path}/index"
    index.save_index(docs.where("doc_id % 3 <> 0"), path)
    index.append_index(docs.where("doc_id % 3 = 0"), path, batch=2)
    found = index.open_index(spark, path)
    want = {r.token: (r.document_count, r.positions_count) for r in index.token_stats(docs).collect()}
    assert {r.token: (r.document_count, r.positions_count) for r in found.stats.collect()} == want
    rows = lambda p: sorted((r.token, r.doc_id, r.title_pos, r.body_pos) for r in p.collect())
    assert rows(found.postings) == rows(index.postings(docs))
    for file in glob.glob(f"{tmp_path}/index/postings/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(file).metadata
        columns = [meta.row_group(g).column(c) for g in range(meta.num_row_groups) for c in range(meta.num_columns)]
        assert "n" in {c.path_in_schema for c in columns}
        lists = [c for c in columns if "_pos" in c.path_in_schema]
        assert all("DELTA_BINARY_PACKED" in c.encodings for c in lists)  # they were plain, after dictionaries that filled up


def test_a_task_makes_postings_of_few_parts(spark, tmp_path):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    docs = catalogue.docs_of(spark, one_row_group(tmp_path))
    index.save_index(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + PAGES)), f"file://{tmp_path}/index", 40)
    parts = [len(glob.glob(f"{tmp_path}/index/{name}/*.parquet")) for name in ("docs", "postings")]
    assert parts[1] >= parts[0] / 4 > 8  # parts were packed until each core had one task, or a task 128 MB
    assert spark.conf.get(key) == before
