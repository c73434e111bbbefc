import random

import pytest

WORDS = "the of and river stone light paper tower garden window silver morning quiet letter winter market bridge candle mirror forest".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="session")
def cases(spark):
    """Documents with nulls, empty and very long texts, copies, near copies, repeated ids, a null id, and columns with clashing names."""
    base = prose(1, 300)
    passage = prose(99, 70)
    rows = [
        (1, base), (2, base), (3, base.replace("river", "ocean", 1)), (4, None), (5, ""), (6, " \n\t "), (7, prose(2, 30_000)), (8, "one"),
        (9, prose(3, 60) + " " + passage + " " + prose(4, 60)), (10, prose(5, 40) + "\n" + passage + " " + prose(6, 20)), (10, prose(7, 80)), (None, base),
        (11, "a b c d e " * 30), (12, passage), (13, "Line one.\nLine one.\nmenu | home | about | us\n"), (14, "é😀 <|endoftext|> 日本 ½ don't\x1cstop"), (5, ""),
    ]
    data = [(i, t, "en", "src", 0, "x", "y", "z", 1.0) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, th string, kept string, score double").cache()


@pytest.fixture(scope="session")
def empty(cases):
    return cases.limit(0)


@pytest.fixture(scope="session")
def rows(cases):
    return [(r["doc_id"], r["text"]) for r in cases.select("doc_id", "text").collect()]
