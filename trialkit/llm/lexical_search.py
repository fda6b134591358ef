"""Ranked lexical search with pair-bound MaxScore.

The corpus is indexed in blocks of documents. A block holds, for every term that queries ask for, the list of its
documents with their impacts (what the term adds to a score) and the largest of them, and, for pairs of terms that
some query has together, the list of the documents that have both and the largest impact the two have jointly.

A query goes through a block by MaxScore. The bound of a set of terms is the sum of bounds over disjoint pairs,
chosen where they save most: two terms whose best documents differ are bounded by what they reach together, not by
the sum of their maxima. Blocks whose bound is below the score to beat are skipped; in others only documents in
the lists of the essential terms are looked at, and each leaves as soon as what it has and what it can still get,
by the pair lists it is in, is below that score. Documents are never shuffled; every task gives its best few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm.common import stored, text_chunks
from trialkit.llm.hashing import ALNUM, Words

TOP = 10
#: Text of queries that is searched for at once. A query beyond it is a batch of its own.
BATCH_BYTES = 16_000_000
#: A block of the index is closed at either bound, whichever comes first.
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 500_000
#: Each term of a query is paired with so many terms that follow it by weight.
NEAR = 2

_LAST = (1 << 63) - 1

INDEX = T.StructType(
    [
        T.StructField("docs", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("maxima", T.ArrayType(T.LongType())),
        T.StructField("spots", T.ArrayType(T.IntegerType())),
        T.StructField("impacts", T.ArrayType(T.LongType())),
        T.StructField("pairs", T.ArrayType(T.IntegerType())),
        T.StructField("pair_counts", T.ArrayType(T.IntegerType())),
        T.StructField("pair_maxima", T.ArrayType(T.LongType())),
        T.StructField("pair_spots", T.ArrayType(T.IntegerType())),
    ]
)


@dataclass
class Queries:
    """A batch of queries: the hashes of their terms in order, and each query's terms as places in it.

    ``weights`` and ``pairs`` follow from the statistics of the corpus.
    """

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    weights: np.ndarray | None = None
    pairs: np.ndarray | None = None  # two columns: the terms of each pair
    #: Per query: pair number, and where its two terms are among the query's own
    pairings: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, rows: Sequence[tuple]) -> Queries:
        parts = []
        for _, data, offsets in text_chunks(pa.array([text for _, text in rows], pa.string())):
            words = Words(data, offsets, ALNUM)
            parts += [np.unique(words.hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
        return cls([i for i, _ in rows], vocabulary, [np.searchsorted(vocabulary, p) for p in parts])

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        """Weights by document frequency; terms without weight are left out, the others paired along their weights."""
        self.weights = np.array(
            [math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * d + 1))) if d else 0 for d in df.tolist()], np.int64
        )
        places: dict[tuple[int, int], int] = {}
        self.pairings = []
        for k, terms in enumerate(self.terms):
            terms = terms[self.weights[terms] > 0]
            self.terms[k] = terms = terms[np.argsort(-self.weights[terms], kind="stable")]
            rows = [
                (places.setdefault((min(a, b), max(a, b)), len(places)), i, j)
                for i, a in enumerate(terms.tolist())
                for j, b in enumerate(terms[i + 1 : i + 1 + NEAR].tolist(), i + 1)
            ]
            self.pairings.append(np.array(rows, np.int64).reshape(-1, 3))
        self.pairs = np.array(list(places), np.int64).reshape(-1, 2)


class Sieve:
    """Which words are query terms, and which ones."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        # a quick test before the search: 2**20 bits by the upper bits of the hash
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[vocabulary >> np.uint64(44)] = True

    def postings(self, data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and text, term and occurrences of every term in a text, by text and term."""
        words = Words(data, offsets, ALNUM)
        sizes = np.diff(words.bounds)
        some = np.flatnonzero(self.maybe[words.hashes >> np.uint64(44)])
        place = np.searchsorted(self.vocabulary, words.hashes[some])
        place[place == len(self.vocabulary)] = 0
        real = self.vocabulary[place] == words.hashes[some] if len(self.vocabulary) else np.zeros(0, bool)
        text = np.repeat(np.arange(len(sizes)), sizes)[some[real]]
        width = max(len(self.vocabulary), 1)
        keys, counts = np.unique(text * width + place[real], return_counts=True)
        return sizes, keys // width, keys % width, counts


def corpus_statistics(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and the documents that hold each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(shared.value)
        sums = np.zeros(len(shared.value) + 2, np.int64)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(1)):
                sizes, _, term, _ = sieve.postings(data, offsets)
                sums[0] += np.count_nonzero(sizes)
                sums[1] += sizes.sum()
                sums[2:] += np.bincount(term, minlength=len(sums) - 2)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["place", "n"])

    # one row per query term and task, added up before they are shuffled
    rows = docs.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(len(vocabulary) + 2, np.int64)
    for row in rows:
        sums[row["place"]] = row["n"]
    return int(sums[0]), int(sums[1]), sums[2:]


def _impacts(weight: np.ndarray, tf: np.ndarray, words: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    # the product may exceed 64 bits before it is divided
    length = {n: 100 - 90 + (90 * n * n_docs) // n_terms for n in np.unique(words).tolist()}
    m = np.array([length[n] for n in words.tolist()], np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def build_block(ids: pa.Array, words: np.ndarray, spot, term, tf, queries: Queries, n_docs: int, n_terms: int) -> dict:
    """One block of the index from the postings of its documents."""
    impact = _impacts(queries.weights[term], tf, words[spot], n_docs, n_terms)
    kept = impact > 0
    spot, term, impact = spot[kept], term[kept], impact[kept]
    order = np.lexsort((spot, term))
    spot, term, impact = spot[order].astype(np.int32), term[order], impact[order]
    terms, starts = np.unique(term, return_index=True)
    counts = np.diff([*starts, len(term)])
    low, high = np.zeros(len(queries.weights), np.int64), np.zeros(len(queries.weights), np.int64)
    low[terms], high[terms] = starts, starts + counts
    dense = np.zeros(len(words), np.int64)
    pairs, pair_counts, pair_maxima, pair_spots = [], [], [], []
    first, second = queries.pairs.T
    here = np.flatnonzero((high[first] > low[first]) & (high[second] > low[second]))
    before = -1
    for p in here[np.argsort(first[here], kind="stable")]:
        a, b = first[p], second[p]
        if a != before:
            if before >= 0:
                dense[spot[low[before] : high[before]]] = 0
            dense[spot[low[a] : high[a]]] = impact[low[a] : high[a]]
            before = a
        other = dense[spot[low[b] : high[b]]]
        both = np.flatnonzero(other)
        if len(both):
            pairs.append(p)
            pair_counts.append(len(both))
            pair_maxima.append(int((other + impact[low[b] : high[b]])[both].max()))
            pair_spots.append(spot[low[b] : high[b]][both])
    return {
        "docs": ids,
        "terms": terms,
        "counts": counts,
        "maxima": np.maximum.reduceat(impact, starts) if len(starts) else starts,
        "spots": spot,
        "impacts": impact,
        "pairs": pairs,
        "pair_counts": pair_counts,
        "pair_maxima": pair_maxima,
        "pair_spots": np.concatenate([np.zeros(0, np.int32), *pair_spots]),
    }


def index_documents(docs: DataFrame, queries: Queries, n_docs: int, n_terms: int) -> DataFrame:
    """The stored index of all documents (columns: id, text): one row per block."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_queries = shared.value
        sieve = Sieve(batch_queries.vocabulary)
        parts: list[tuple] = []
        size = postings = 0

        def block() -> pa.RecordBatch:
            starts = np.cumsum([0, *[len(p[1]) for p in parts]])
            spot = np.concatenate([p[2] + s for p, s in zip(parts, starts[:-1], strict=True)])
            words, term, tf = (np.concatenate([p[k] for p in parts]) for k in (1, 3, 4))
            ids = pa.concat_arrays([p[0] for p in parts])
            row = build_block(ids, words, spot, term, tf, batch_queries, n_docs, n_terms)
            columns = []
            for name in INDEX.names:
                kind = pa.int64() if INDEX[name].dataType.elementType == T.LongType() else pa.int32()
                values = row[name] if isinstance(row[name], pa.Array) else pa.array(row[name], kind)
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind)))
            return pa.RecordBatch.from_arrays(columns, INDEX.names)

        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, data, offsets in text_chunks(batch.column(1)):
                found = sieve.postings(data, offsets)
                parts.append((ids.slice(first, len(found[0])), *found))
                size, postings = size + len(found[0]), postings + len(found[1])
                if size >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield block()
                    parts, size, postings = [], 0, 0
        if parts:
            yield block()

    return stored(docs.mapInArrow(build, INDEX), "search-index")


class Best:
    """The highest scores of one query so far; equal ones by ascending document."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def beaten(self) -> int:
        """A document needs this score at least, or any above 0 while places are free."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        order = np.lexsort((keys, -scores))[: self.top]
        self.scores, self.keys = scores[order], keys[order]


class Block:
    """A block of the index as arrays over terms and pairs."""

    def __init__(self, row: dict, queries: Queries):
        self.queries = queries
        self.keys = row["docs"]
        self.spots, self.impacts, self.pair_spots = row["spots"], row["impacts"], row["pair_spots"]
        self.low, self.high, self.maxima = self._spread(row["terms"], row["counts"], row["maxima"], len(queries.weights))
        self.pair_low, self.pair_high, self.pair_maxima = self._spread(
            row["pairs"], row["pair_counts"], row["pair_maxima"], len(queries.pairs)
        )
        self.sums = np.zeros(len(self.keys), np.int64)
        #: Postings that queries have read.
        self.read = 0

    @staticmethod
    def _spread(places, counts, maxima, n: int):
        low, high, most = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = np.cumsum(counts)
        low[places], high[places], most[places] = ends - counts, ends, maxima
        return low, high, most

    def split(self, query: int, need: int, use_pairs: bool = True) -> tuple[list[tuple[int, int, int, list[int]]], list[int]]:
        """Terms that cannot give ``need`` together, as pairs and single terms, and the essential ones.

        Terms come in by their maxima, the smallest first, each with the free term before it with which it saves
        most, while the bound of all that came in stays below ``need``. Each group has its bound, its bound outside
        the pair list, the pair or -1, and its terms; the largest bound comes last.
        """
        terms, pairing = self.queries.terms[query], self.queries.pairings[query]
        most = self.maxima[terms]
        pair, a, b = pairing.T
        alone = np.maximum(most[a], most[b])
        bound = np.maximum(alone, self.pair_maxima[pair])
        saved = most[a] + most[b] - bound
        partners: dict[int, list[tuple[int, int, int]]] = {}
        for k in np.flatnonzero(saved > 0) if use_pairs else ():
            partners.setdefault(int(a[k]), []).append((int(saved[k]), int(b[k]), int(k)))
            partners.setdefault(int(b[k]), []).append((int(saved[k]), int(a[k]), int(k)))
        order = [i for i in np.argsort(most, kind="stable").tolist() if most[i] > 0]
        total, taken, single, pairs = 0, 0, {}, []
        for i in order:
            saving, other, k = max((x for x in partners.get(i, ()) if x[1] in single), default=(0, -1, -1))
            if total + int(most[i]) - saving >= need:
                break
            total += int(most[i]) - saving
            taken += 1
            if k < 0:
                single[i] = int(most[i])
            else:
                del single[other]
                pairs.append((int(bound[k]), int(alone[k]), int(pair[k]), [int(terms[i]), int(terms[other])]))
        groups = pairs + [(u, u, -1, [int(terms[i])]) for i, u in single.items()]
        return sorted(groups, key=lambda g: g[0]), [int(terms[i]) for i in order[taken:]]

    def search(self, query: int, best: Best, use_pairs: bool = True) -> None:
        """Put the documents of the block that are among the best of a query there."""
        need = best.beaten
        if int(self.maxima[self.queries.terms[query]].sum()) < need:
            return
        groups, essential = self.split(query, need, use_pairs)
        if not essential:
            return  # all terms together stay below
        rest = sum(g[0] for g in groups)
        sums, touched = self.sums, []
        for t in essential:
            at = self.spots[self.low[t] : self.high[t]]
            sums[at] += self.impacts[self.low[t] : self.high[t]]
            self.read += len(at)
            touched.append(at)
        found = np.unique(np.concatenate(touched))
        some, scores = found, sums[found]
        sums[found] = 0
        for bound, alone, pair, terms in reversed(groups):
            if len(scores) >= best.top:
                # what documents have already is a score to beat as well
                need = max(need, int(np.partition(scores, -best.top)[-best.top]))
            rest -= bound
            if pair >= 0 and bound > alone:
                both = self._within(self.pair_spots[self.pair_low[pair] : self.pair_high[pair]], some)[0]
                kept = scores + rest + np.where(both, bound, alone) >= need
            else:
                kept = scores + rest + bound >= need
            some, scores = some[kept], scores[kept]
            for t in terms:
                has, at = self._within(self.spots[self.low[t] : self.high[t]], some)
                scores[has] += self.impacts[self.low[t] + at[has]]
                self.read += int(has.sum())
        kept = scores >= need
        best.add(scores[kept], self.keys[some[kept]])

    @staticmethod
    def _within(listed: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(listed):
            return np.zeros(len(some), bool), np.zeros(len(some), np.int64)
        at = np.searchsorted(listed, some)
        at[at == len(listed)] = 0
        return listed[at] == some, at


def _arrays(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = {name: batch.column(batch.schema.get_field_index(name)) for name in INDEX.names}
    for k in range(batch.num_rows):
        row = {name: column[k].values for name, column in columns.items()}
        row["docs"] = row["docs"].fill_null(_LAST)
        yield {name: values.to_numpy(zero_copy_only=False) for name, values in row.items()}


def search_index(index: DataFrame, queries: Queries, top: int) -> DataFrame:
    """The best of every task for each query: ``query`` (its number), ``doc``, ``score``."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [Best(top) for _ in asked.terms]
        for batch in batches:
            for row in _arrays(batch):
                block = Block(row, asked)
                for k, found in enumerate(best):
                    block.search(k, found)
        number = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        parts = [np.concatenate([np.zeros(0, np.int64), *[getattr(b, x) for b in best]]) for x in ("keys", "scores")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, *parts)], ["query", "doc", "score"])

    return index.mapInArrow(search, "query long, doc long, score long")


def _batches(rows: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Queries in batches of at most ``limit`` bytes of text; the driver holds one batch at a time."""
    batch, size = [], 0
    for row in rows.toLocalIterator():
        length = len((row[1] or "").encode())
        if batch and size + length > limit:
            yield batch
            batch, size = [], 0
        batch.append((row[0], row[1]))
        size += length
    if batch:
        yield batch


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """The ``top`` documents of every item by score: ``item_id``, ``rank`` from 1, ``doc_id`` and ``score``.

    Only scores above 0 count; equal ones are ranked by ascending ``doc_id``, an integer, a NULL one last. NULL and
    empty texts have no terms: such documents are never found, such items find nothing. Repeated documents are
    ranked each for itself, repeated items (also with one id) get their rows each. Other columns play no part.
    Every batch of items builds an index of all documents over its own terms.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`"))
    kind = items.schema[item_id].dataType
    schema = T.StructType(
        [
            T.StructField("item_id", kind),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )
    parts = []
    for batch in _batches(items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")), batch_bytes):
        queries = Queries.of(batch)
        n_docs, n_terms, df = corpus_statistics(corpus, queries.vocabulary)
        queries.weigh(n_docs, df)
        found = search_index(index_documents(corpus, queries, n_docs, n_terms), queries, top)
        # a task gives at most `top` rows for a query; no more of them are shuffled
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(
            list(enumerate(queries.ids)), T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", kind)])
        )
        doc = F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id")
        parts.append(ranked.join(names, "query").select("item_id", "rank", doc, "score"))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


SEARCH_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), queries AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0
), counted AS (
  SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM queries JOIN counted USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
