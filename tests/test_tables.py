"""Table functions in SQL against the operators that say the same in expressions."""

from pyspark.sql import functions as F

from sessionloom.functions import tables
from sessionloom.operators import curation, review

TEXTS = [
    None, "", "   ", "plain", "# One\nbody\n\n## Two\nmore", "no heading\n####### seven\n###### six\n#none", "a" * 25 + "\n# h\n" + "b" * 31, "  # pad\nx\r\n\r\n# y\r\nz",
    "# at start", "x # after a separator\rold# no\r# yes", "é" * 23, " " * 30 + "tail", "a\n\t\nb", "\n\n\n", "#\tTab\nx",
]


def test_equal_to_the_expressions(spark):
    tables.register(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("chunk", F.lit("clash")).repartition(3)
    rows = lambda d: sorted(map(tuple, d.collect()))
    got = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL text_chunks(d.text, 10) c", docs=docs)
    assert rows(got) == rows(review.chunks(docs, "doc_id", "text", 10)) and got.count() > 20
    got = spark.sql("SELECT d.doc_id, b.* FROM {docs} d, LATERAL text_blocks(d.text) b", docs=docs)
    assert rows(got) == rows(curation.rule_blocks(docs)) and got.count() == 15
    assert spark.sql("SELECT c.* FROM {docs} d, LATERAL text_chunks(d.text, 10) c", docs=docs.limit(0)).count() == 0
