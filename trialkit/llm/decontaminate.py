"""Benchmark decontamination: find word windows of test items in documents.

The windows of the benchmark items, normalised and hashed, are broadcast; tasks scan the word windows of
their documents, verify every hit on the words themselves, and flag, cut or drop. Documents are never
shuffled. A benchmark beyond ``BLOCK_BYTES`` is taken in blocks of that size, one scan per block, so what
is broadcast never outgrows the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm.common import fresh, stored, text_chunks
from trialkit.llm.hashing import ALNUM, FOLD, Words

WINDOW = 10
#: Text of benchmark items indexed and broadcast at once. An item beyond it is a block of its own.
BLOCK_BYTES = 4_000_000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_bytes", T.ArrayType(T.LongType())),
    ]
)


class WindowIndex:
    """Windows of some benchmark items: by length, sorted hashes and the places of the windows.

    A window is ``window`` consecutive words, or all words of an item that has fewer.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names = [name for name, _ in items]
        texts = pa.array([text for _, text in items], pa.string())
        found: dict[int, list[tuple]] = {}
        base, plain = 0, []
        for first, data, offsets in text_chunks(texts):
            words = Words(data, offsets, ALNUM)
            counts = np.diff(words.bounds)
            item_of = np.repeat(np.arange(len(counts)), counts)
            # the words of an item as they are compared: folded, one blank between
            sizes = words.ends - words.starts
            spots = np.concatenate([[0], np.cumsum(sizes + 1)])
            folded = FOLD[data].tobytes()
            plain.append(b"".join(folded[s:e] + b" " for s, e in zip(words.starts, words.ends, strict=True)))
            for length in sorted({min(window, int(c)) for c in counts if c}):
                hashes, at = words.windows(length)
                if length < window:
                    short = counts[item_of[at]] == length
                    hashes, at = hashes[short], at[short]
                found.setdefault(length, []).append(
                    (hashes, item_of[at] + first, spots[at] + base, spots[at + length] - 1 + base)
                )
            base += int(spots[-1])
        self.text = b"".join(plain)
        self.by_length = {}
        for length, parts in found.items():
            hashes, item, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.by_length[length] = hashes[order], item[order], start[order], end[order]
        # a quick sieve before the search: 2**20 bits by the upper bits of the hash
        self.sieve = {k: np.zeros(1 << 20, bool) for k in self.by_length}
        for k, (hashes, *_) in self.by_length.items():
            self.sieve[k][hashes >> np.uint64(44)] = True

    def search(self, words: Words, folded: bytes):
        """Yield (first word, length, items) for every window of an item among the words of the texts."""
        for length, (hashes, item, start, end) in self.by_length.items():
            seen, at = words.windows(length)
            some = np.flatnonzero(self.sieve[length][seen >> np.uint64(44)])
            low = np.searchsorted(hashes, seen[some], side="left")
            high = np.searchsorted(hashes, seen[some], side="right")
            for k in np.flatnonzero(low < high):
                word = int(at[some[k]])
                mine = b" ".join(
                    folded[words.starts[w] : words.ends[w]] for w in range(word, word + length)
                )
                items = {
                    self.names[item[j]]
                    for j in range(low[k], high[k])
                    if self.text[start[j] : end[j]] == mine
                }
                if items:
                    yield word, length, items


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most ``limit`` bytes of text; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(f"`{item}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        if not row[1]:
            continue
        length = len(row[1].encode())
        if block and size + length > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += length
    if block:
        yield block


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add a struct ``found`` to each document: words, hit word numbers, items, hit byte ranges.

    ``n_words``; ``hit_words`` in order; ``items`` the distinct item names with an occurring window (an
    item without a name hits but is not listed), sorted; ``hit_bytes`` flat pairs of start and end of runs
    of hit words. NULL and empty texts have no words. An empty benchmark hits nothing. ``text`` itself
    stays only if ``carry``. Repeated documents are treated alike, each for itself.
    """
    (found,) = fresh(docs, "found")
    spark = docs.sparkSession
    state = docs.withColumn(found, F.lit(None).cast(FOUND))
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        index = spark.sparkContext.broadcast(WindowIndex(block, window))
        last = following is None
        state = _scan(state, index, text, found, carry or not last)
        if last:
            return state
        state, block = stored(state, "windows"), following


def _scan(docs: DataFrame, index, text: str, found: str, carry: bool) -> DataFrame:
    out = T.StructType([f for f in docs.schema if carry or f.name != text])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = index.value
        for batch in batches:
            before = batch.column(batch.schema.get_field_index(found)).to_pylist()
            rows = []
            for first, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text))):
                rows += _found(windows, data, offsets, before[first:])
            kind = batch.schema.field(found).type
            columns = [
                pa.array(rows, kind) if f.name == found else batch.column(batch.schema.get_field_index(f.name))
                for f in out
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out])

    return docs.mapInArrow(scan, out)


def _found(index: WindowIndex, data, offsets, before) -> list[dict]:
    words = Words(data, offsets, ALNUM)
    folded = FOLD[data].tobytes()
    hits: dict[int, set[int]] = {}
    items: dict[int, set[str]] = {}
    for word, length, names in index.search(words, folded):
        doc = int(np.searchsorted(words.bounds, word, side="right")) - 1
        hits.setdefault(doc, set()).update(range(word, word + length))
        items.setdefault(doc, set()).update(n for n in names if n is not None)
    rows = []
    for doc in range(len(offsets) - 1):
        low, high = int(words.bounds[doc]), int(words.bounds[doc + 1])
        old = before[doc] or {"hit_words": [], "items": []}
        hit = sorted({w - low for w in hits.get(doc, ())} | set(old["hit_words"]))
        spans: list[int] = []
        for w in hit:
            start, end = (int(x[low + w] - offsets[doc]) for x in (words.starts, words.ends))
            if spans and hit_before == w - 1:
                spans[-1] = end
            else:
                spans += [start, end]
            hit_before = w
        rows.append(
            {
                "n_words": high - low,
                "hit_words": hit,
                "items": sorted(items.get(doc, set()) | set(old["items"])),
                "hit_bytes": spans,
            }
        )
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """The documents without what the benchmark holds, with the columns of ``docs``.

    ``remove="documents"`` drops every document with a hit, ``"spans"`` cuts the hit words out of its text
    and leaves a line break in their place.
    """
    rows = find_windows(docs, benchmark, text, **options)
    found = rows.columns[-1]
    names = [F.col(f"`{c}`") for c in docs.columns]
    if remove == "documents":
        return rows.where(F.size(f"{found}.hit_words") == 0).select(*names)
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(body, pairs):
            if body is None or not len(pairs):
                return body
            raw, parts, at = body.encode(), [], 0
            for start, end in zip(pairs[::2], pairs[1::2], strict=True):
                parts.append(raw[at:start])
                at = end
            return b"\n".join([*parts, raw[at:]]).decode()

        return texts.combine(spans, one)

    return rows.withColumn(text, cut(F.col(f"`{text}`"), F.col(f"{found}.hit_bytes"))).select(*names)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hits per document: the digest of the query."""
    rows = find_windows(docs.select("doc_id", "text"), benchmark, carry=False)
    names = F.array_join(F.array_sort("found.items"), ",")
    n_hit = F.size("found.hit_words").cast("bigint")
    return rows.select(
        "doc_id",
        "found.n_words",
        n_hit.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


CONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
  FROM items, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT k FROM item_windows
), doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS key
  FROM docs, lengths, unnest(generate_series(1, len(w) - k + 1)) AS t(i) WHERE len(w) >= k
), hits AS (
  SELECT d.doc_id, d.i, d.k, m.item_id FROM doc_windows d JOIN item_windows m ON d.k = m.k AND d.key = m.key
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + k - 1)) AS t(p) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
