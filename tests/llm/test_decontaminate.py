import hashlib
import random
import re

import pytest

from trialkit.llm.decontaminate import contamination_report, decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def expected(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = {}
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                names = windows.get(tuple(w[k : k + n]))
                if names:
                    hit |= set(range(k, k + n))
                    found |= {str(x) for x in names if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def tables(seed):
    rng = random.Random(seed)
    draw = lambda n: [rng.choice(["Alpha", "beta", "Gamma", "dé", "x1", "É", "z"]) + str(rng.randrange(9)) for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([0, 1, 4, 9, 10, 11, 30])))) for i in range(30)]
    items += [(100, items[3][1]), (None, " ".join(draw(12))), (101, None)]
    docs = []
    for i in range(80):
        parts = draw(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            piece = (rng.choice(items)[1] or "").upper().split()
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = piece[: rng.choice([5, 12, 99])]
        docs.append((i, rng.choice([" ", ", ", "\n-"]).join(parts)))
    return [*docs, (900, None), (901, "")], items


@pytest.mark.parametrize("block_bytes", [4_000_000, 300])
def test_hits_equal_brute_force(spark, block_bytes):
    docs, items = tables(block_bytes)
    from trialkit.llm import decontaminate as module

    found = module.find_windows(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        block_bytes=block_bytes,
    ).collect()
    want = expected(docs, items)
    for r in found:
        n_words, n_hit, n_items, _, _ = want[r["doc_id"]]
        assert (r["found"]["n_words"], len(r["found"]["hit_words"]), len(r["found"]["items"])) == (n_words, n_hit, n_items)


def test_report(spark):
    docs, items = tables(5)
    got = contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == expected(docs, items)


def test_documents_or_spans_are_removed(spark):
    passage = "the quick brown fox jumps over the lazy dog again today"
    docs = spark.createDataFrame([(1, f"Start. {passage.title()}! End é."), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate(docs, bench).collect()] == [2]
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {1: "Start. \n! End é.", 2: "clean text"}
    with pytest.raises(ValueError):
        decontaminate(docs, bench, remove="all")
