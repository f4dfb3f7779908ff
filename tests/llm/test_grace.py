import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from clanmark.llm.grace import ContentTable, buckets, drop_copies, exact_copies

from . import samples


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        best = min(groups[plain(t)], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()))
    return out


def found(df):
    return df.select("doc_id", "keep_id", "group_size", "text_sha256")


def test_against_brute_force(spark):
    rows = samples.texts()
    for size in (300, 32 << 20):
        got = exact_copies(samples.documents(spark, rows, size), bucket_bytes=size)
        assert Counter(map(tuple, found(got).collect())) == Counter(brute(rows))
    kept = got.where("kept").groupBy("text_sha256").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == len({r[3] for r in brute(rows)})


def test_rows_that_stay_have_their_columns(spark):
    docs = samples.documents(spark)
    out = drop_copies(docs)
    assert out.columns == docs.columns and out.count() == len({plain(t) for _, t in samples.texts()})
    assert drop_copies(samples.empty(spark)).count() == 0


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_copies(docs.repartition(5))
    assert got.where("group_size = 1000 AND keep_id = 0").count() == 1000 and got.where("kept").count() == 2001


def test_table_compares_contents():
    table = ContentTable(4)
    assert [table.put(5, b"a"), table.put(5, b"b"), table.put(9, b"a"), table.put(5, b"a")] == [0, 1, 2, 0]
    assert [table.put(i, bytes([i])) for i in range(100, 200)] == list(range(3, 103))
    assert [table.put(i, bytes([i])) for i in range(100, 200)] == list(range(3, 103))


def test_buckets_are_dealt_again_until_they_fit(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("hash"), F.lit(10).cast("long").alias("n_bytes"))
    sizes = rows.groupBy(buckets(rows, 500, fan=4).alias("b")).agg(F.sum("n_bytes").alias("n")).collect()
    assert max(r.n for r in sizes) <= 1000 and sum(r.n for r in sizes) == 20000
