"""The draw by importance against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialkit.llm.resampling import crc32_spans, first_rows, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    parts = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), parts


def plain(docs, target, run, buckets, percent, least):
    def bucket(part):
        return zlib.crc32(part.encode()) % buckets

    s = Counter(bucket(p) for _, text in docs for p in runs(text, run)[1])
    t = Counter(bucket(p) for text in target for p in runs(text, run)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for doc, text in docs:
        n, parts = runs(text, run)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in map(bucket, parts)
        )
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(parts), weight, score, n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def rows_of(seed):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(50)] + ["Ä", "é" * 40, "x" * 90, "A1", "a1"]
    docs = [(k, " ".join(rng.choice(names) for _ in range(rng.randrange(60)))) for k in range(300)]
    docs += [(None, None), (None, "w1 " * 30), (1000, ""), (1001, " , "), (1002, "long " * 200_000)]
    return docs, [" ".join(rng.choice(names[:20]) for _ in range(30)) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize(("run", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 97, 35, 3), (3, 5, 100, 0), (1, 64, 0, 20)])
def test_against_plain_python(spark, run, buckets, percent, least):
    docs, target = rows_of(run)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), run=run, buckets=buckets, percent=percent, least_words=least)

    def order(r):
        return tuple((x is None, x or 0) for x in r)

    assert sorted((tuple(r) for r in out.collect()), key=order) == sorted(plain(docs, target, run, buckets, percent, least), key=order)


def test_repeated_rows_are_drawn_one_by_one(spark):
    """A hundred equal rows: the cutoff falls between rows that no key of the contract tells apart."""
    docs = spark.createDataFrame([(7, "a b c " * 10)] * 100, "doc_id long, text string").repartition(4)
    out = resample(docs, docs.limit(1), percent=33).where("rank IS NOT NULL")
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 34))


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, 6)], "doc_id long, text string, n_words string, place_ int, Rank int")
    out = resample(docs, docs.limit(0), least_words=1, percent=100)
    assert out.columns == ["doc_id", "n_words", "place_", "n_features", "weight", "score", "rank"]
    assert [(r["n_words"], r["place_"], r["n_features"], r["rank"]) for r in out.collect()] == [("s", 5, 2, 1)]
    assert resample(docs.limit(0), docs).collect() == []


def test_bisection_finds_the_first_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([-5, 0, 0, 0, 9, 2**40, -(2**50)]), rng.randrange(4), k) for k in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    keys = [F.col("a"), F.col("b"), F.col("c")]
    for need in (0, 1, 57, 200, 399, 400, 500):
        got = sorted(tuple(r) for r in df.where(first_rows(df, keys, need)).collect())
        assert got == sorted(rows)[:need]


def test_crc_of_spans():
    data = np.frombuffer(b"abc def " + b"q" * 100 + b"\xc3\xa9", np.uint8)
    starts, ends = np.array([0, 4, 8, 0, 108]), np.array([3, 7, 108, 0, 110])
    assert crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[s:e]) for s, e in zip(starts, ends, strict=True)]
