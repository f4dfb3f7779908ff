"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, clashing names."""

import random

KIND = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, label string, "
    "kept string, bucket string, score string, `a.b` string, rid long, hash string"
)


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    long = words(1, 3000)
    rows = [(i, words(i, 30 + i)) for i in range(10, 40)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, long), (7, long), (7, long)]
    rows += [(None, words(11, 41)), (None, None), (None, "only a null id"), (8, words(12, 42)), (9, "  " + words(12, 42))]
    rows += [(100 + i, words(500, 80) + f" tail{i}") for i in range(12)]
    rows += [(200, "\n".join([words(900, 60), words(901, 20), words(902, 5)])), (201, words(903, 9) + "\n" + words(900, 60))]
    rows += [(202, "É é 日本 \x1f x y"), (203, "<s>[INST] x [/INST]</s>&amp;"), (204, words(13, 8) + "\r\n\r\n")]
    return rows


def documents(spark, rows=None, shuffle: int | None = None):
    rows = texts() if rows is None else rows
    if shuffle is not None:
        rows = list(rows)
        random.Random(shuffle).shuffle(rows)
    full = [
        (i, t, ("en", None, "de")[k % 3], f"src{k % 4 if k % 3 else 0}", len(t or ""), "r", k, "l", None, "b", "s", "x", k, None)
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, KIND).repartition(3)


def empty(spark):
    return spark.createDataFrame([], KIND)
