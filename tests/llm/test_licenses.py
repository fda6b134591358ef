"""License scans against plain Python on hand-made rows."""

import random
import re

from trialkit.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, find_blocks, license_report, template_sets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(text, templates=TEMPLATES, threshold=THRESHOLD):
    words = plain_words(text)
    places, base, extra, best = [], set(), set(), 0.0
    for phrase, label in PHRASES.items():
        part = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(part)] == part]
        places += found
        base |= {label} if found else set()
    for t in template_sets(templates, threshold):
        for first in range(0, len(words), t.step):
            shared = len(set(words[first : first + 2 * t.step]) & set(t.words))
            if shared >= t.needed:
                extra.add(t.label)
                best = max(best, shared / len(t.words))
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | extra)),
        1.0 if base else best,
    )


def texts():
    rng = random.Random(5)
    pool = sorted({w for _, t in TEMPLATES for w in plain_words(t)}) + [f"w{k}" for k in range(40)]
    out = [None, "", " . ", "MIT", "apache Apache LICENSE, cc by cc-by", "licenſe mit licenſe worK mit license"]
    for _, notice in TEMPLATES:
        words = notice.split()
        for keep in (1.0, 0.95, 0.85):
            cut = [w for w in words if rng.random() < keep]
            lead, tail = ([rng.choice(pool) for _ in range(rng.randrange(60))] for _ in range(2))
            out.append(" ".join([*lead, *cut, *tail]))
    out += [" ".join(rng.choice(pool) for _ in range(n)) for n in (5, 31, 32, 33, 64, 65, 300, 5000)]
    out.append("apache " * 3000 + " ".join(t for _, t in TEMPLATES) + " license" * 500)
    return out


def test_report_against_plain_python(spark):
    rows = list(enumerate(texts()))
    got = {r[0]: tuple(r[1:]) for r in license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        assert got[doc] == plain(text), (doc, text)


def test_low_threshold_loses_no_block(spark):
    """The filters drop pairs only that cannot meet the threshold, and no pair is found twice."""
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest, hits = find_blocks(docs, threshold=0.5)
    got = sorted((r["doc_id"], r["label"], r["first_word"], r["last_word"]) for r in digest.join(hits, "row").collect())
    want = []
    for doc, text in rows:
        words = plain_words(text)
        for t in template_sets(TEMPLATES, 0.5):
            for first in range(0, len(words), t.step):
                block = words[first : first + 2 * t.step]
                if len(set(block) & set(t.words)) >= t.needed:
                    want.append((doc, t.label, first, first + len(block) - 1))
    assert got == sorted(want)


def test_own_phrases_and_templates(spark):
    docs = spark.createDataFrame([(1, "see the Zlib License here"), (2, "all rights reserved by us")], "id long, body string")
    out = license_report(docs, "id", "body", phrases={"zlib license": "zlib"}, templates=[("arr", "All rights reserved.")])
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 5, 1, 2, 2, "zlib", "zlib", 1.0),
        (2, 5, 0, None, None, "", "arr", 1.0),
    ]
    assert license_report(docs, "id", "body", templates=[("none", " ")]).where("labels <> ''").count() == 0
