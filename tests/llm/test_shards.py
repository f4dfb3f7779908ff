import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from clanmark.llm.shards import kd_shards

from . import samples


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return {s: sum(r.size for r in got if r.shard == s) for s in range(shards)}


def test_odd_rows(spark):
    rows = samples.texts()
    got = kd_shards(samples.documents(spark, rows), 2).collect()
    check(rows, got, 2)
    leaf = sum(r.size for r in got) / 2
    groups = Counter()
    for r in got:
        groups[r.text_crc32, r.size] += r.size
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for g, s in homes.items() if groups[g] <= leaf)
    assert kd_shards(samples.empty(spark), 4).count() == 0


def test_equal_bytes_with_any_number_of_shards(spark):
    rows = [(i, samples.words(i, 5 + i % 60)) for i in range(3000)]
    for shards in (1, 5):
        sizes = check(rows, kd_shards(samples.documents(spark, rows), shards).collect(), shards)
        mean = sum(sizes.values()) / shards
        assert all(abs(s - mean) < 0.02 * mean for s in sizes.values())
    total = sum(len(t) + 1 for _, t in rows)
    got = kd_shards(samples.documents(spark, rows), target_bytes=total // 3 + 1)
    assert got.select(F.max("shard")).first()[0] == 2


def test_heavy_groups(spark):
    """A group of most of a shard stays whole; one that is larger than a shard is split evenly."""
    rows = [(i, samples.words(i, 20)) for i in range(1000)]
    share = sum(len(t) + 1 for _, t in rows) // 8
    some = samples.words(7, 30)
    rows += [(5000 + i, some) for i in range(int(share * 0.6 / (len(some) + 1)))]
    got = kd_shards(samples.documents(spark, rows), 8).collect()
    sizes = check(rows, got, 8)
    mean = sum(sizes.values()) / 8
    assert all(abs(s - mean) < 0.05 * mean for s in sizes.values())
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1
    rows = [(i, some) for i in range(900)] + rows[:300]
    sizes = check(rows, kd_shards(samples.documents(spark, rows), 8).collect(), 8)
    mean = sum(sizes.values()) / 8
    assert all(abs(s - mean) < 0.25 * mean for s in sizes.values())
