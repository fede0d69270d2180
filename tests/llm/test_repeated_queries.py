"""A query row that stands twice is answered twice, with all its ranks."""

from collections import Counter

from pyspark.sql import functions as F

from quillstone.llm import exact_topk, hash_forest


def test_repeated_queries_lose_no_rank(spark):
    rows = [(0, [3.0, 1.0]), (0, [3.0, 1.0])] + [(i, [float(i), 9.0 - i]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = df.select("vec_id", F.transform("embedding", lambda x: F.floor(x)).alias("embedding"))
    inner = sorted(range(1, 9), key=lambda i: (-(3 * i + 9 - i), i))[:5]
    cosine = sorted(range(1, 9), key=lambda i: -(3 * i + 9 - i) / (i * i + (9 - i) ** 2) ** 0.5)[:5]
    for found, best in ((exact_topk.exact_topk(whole, whole.where("vec_id = 0"), 5), inner), (hash_forest.nearest(hash_forest.index(df), df.where("vec_id = 0"), 5), cosine)):
        assert Counter((r["rank"], r["vec_id"]) for r in found.collect()) == Counter({(n + 1, v): 2 for n, v in enumerate(best)})
