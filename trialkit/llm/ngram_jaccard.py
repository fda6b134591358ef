"""Similarity join of documents on their word shingles, by universe partition and pigeonhole, exact.

Two sets link when 100 * intersection >= 75 * union; then they differ in at most a seventh of the sum of
their sizes, H = (r + s) // 7 shingles.

*Segments.* The universe of shingles is cut by hash into 2**j segments, j by size band. A document's subset
in a segment, hashed, is a key. Documents with equal subsets in a segment meet there. A document of n
shingles shows its first ``H + 1 + guard`` segments that are not empty. Of two linked documents, take the
one whose shown segments end first: the other shows all of these that are equal in both, and at most H
differ, so they meet in at least ``guard + 1`` keys.

*One-deletion neighbourhoods.* In the band of the smallest sets one segment holds the whole set. There a
document shows its subset and each subset with one shingle deleted, which meets any set that differs in one.

*Cost-based allocation.* Where many unlinked documents share a key (a passage that is everywhere, the common
part of near copies), pairs are not made from it. A document can spare as many keys as its guard; those that
would have to spare more show every shingle as a segment of its own in a second index, made among them alone.
There two linked documents meet in their whole intersection, so of three quarters of its shingles a document
can spare all but one: what it has of its own finds its partners.

*Verification.* Candidates that share enough keys are compared shingle by shingle. Copies are one node. In
a group of near copies documents are first compared with the most central one, whose keys are the commonest,
so that pairs are only made between documents that are not connected yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.llm.common import forget, fresh, numbered, stored, text_chunks
from trialkit.llm.hashing import SOLID, Words, mix, run_hashes

WIDTH = 5
#: Sets of up to so many shingles are one segment with its one-deletion neighbourhood.
SMALLEST = 5
#: Size bands: largest set and bits of the segment number. A band has far more segments than shingles.
BANDS = ((1 << 20, 24), (1 << 26, 30), (1 << 62, 36))
#: Keys shown beyond the pigeonhole bound: so many, and a part of the bound.
GUARD, GUARD_PART = 8, 16
#: Pairs of unconnected documents in a key beyond which it is spared.
COSTLY = 50
#: Rounds of comparing with central documents before pairs are made.
PIVOT_ROUNDS = 1
#: A table of node numbers up to so many rows is broadcast to find its texts; a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _segment_bits(n: int) -> int:
    return next(bits for largest, bits in BANDS if n <= largest)


def guard(n: int) -> int:
    """Small sets have fewer segments to spare; two may fall together by chance, hence the 3."""
    return max(0, min(GUARD + (n // 3) // GUARD_PART, n - n // 3 - 3))


def _guard(n: Column) -> Column:
    third = F.floor(n / 3)
    return F.greatest(F.lit(0), F.least(F.lit(GUARD) + F.floor(third / GUARD_PART), n - third - 3))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in text_chunks(texts):
        words = Words(data, offsets, SOLID)
        hashes, at = words.windows(width)
        cut = np.searchsorted(at, words.bounds)
        counts = np.diff(words.bounds)
        for i, n in enumerate(counts):
            if n >= width:
                found = np.sort(hashes[cut[i] : cut[i + 1]])
                first = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=first[1:])
                yield found[first]
            elif n:
                # fewer words: the whole sequence, marked with its length
                whole = run_hashes(words.hashes[words.bounds[i] : words.bounds[i + 1]], int(n))
                yield mix(whole + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def segment_keys(found: np.ndarray, shown: int) -> np.ndarray:
    """Keys of the first ``shown`` segments that are not empty."""
    n = len(found)
    keys = []
    if n <= SMALLEST + 1:
        # also one larger, which may link with a set of the smallest band
        with np.errstate(over="ignore"):
            every = mix(found ^ np.uint64(0x5851F42D4C957F2D))
            whole = every.sum(dtype=np.uint64)
            near = np.concatenate([[whole], whole - every]) if n > 1 else np.array([whole], np.uint64)
        keys.append(mix(near ^ np.uint64(0x14057B7EF767814F)))
    if n > SMALLEST:
        bands = {_segment_bits(n), _segment_bits(max(n * 3 // 4, SMALLEST + 1))}
        for bits in bands:
            segment = found >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))[:shown]
            upto = starts[-1] + int(np.searchsorted(segment[starts[-1] :], segment[starts[-1]], side="right"))
            with np.errstate(over="ignore"):
                subsets = np.add.reduceat(mix(found[:upto]), starts)
                keys.append(mix(subsets + segment[starts] * np.uint64(2 * bits + 1)))
    return np.concatenate(keys)


def _described(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, a hash of its text, the size of its set and two hashes of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in shingle_sets(batch.column(2)):
                with np.errstate(over="ignore"):
                    a = mix(found).sum(dtype=np.uint64)
                    b = mix(found ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
                rows.append((len(found), a.view(np.int64), b.view(np.int64)))
            if rows:
                columns = [pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "n", "a", "b"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, n bigint, a bigint, b bigint"
    return docs.mapInArrow(work, schema)


def _texts_of(docs: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """``id, text`` of the row that stands for each node."""
    wanted = nodes.select("id", F.col("rep.doc_id").alias("of"), F.col("rep.text_hash").alias("hash"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("of")) & (docs.text_hash == F.col("hash"))).select("id", "text")
    return found.dropDuplicates(["id"]) if repeated else found


def _keys(texts: DataFrame) -> DataFrame:
    """``key, id`` of the shown segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in shingle_sets(batch.column(1)):
                n = len(found)
                out.append(segment_keys(found, n // 3 + 1 + guard(n)).view(np.int64))
            if out:
                sizes = np.cumsum([0, *map(len, out)])
                # a few long texts must not make one batch of lists too long
                lists = pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), pa.array(np.concatenate(out)))
                keys = lists.cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["id", "keys"])

    return texts.mapInArrow(work, "id bigint, keys array<bigint>").select(F.explode("keys").alias("key"), "id")


def _sets(texts: DataFrame) -> DataFrame:
    """``id``, the size of its set, and its sorted shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(shingle_sets(batch.column(1)))
            if out:
                sizes = np.array([len(x) for x in out], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists], ["id", "n", "shingles"])

    return texts.mapInArrow(work, "id bigint, n bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u``, ``v``) that link."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("mine"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("theirs"))
    rows = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "mine", "theirs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for mine, theirs in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (x.values.to_numpy() for x in (mine, theirs))
                both = np.sort(np.concatenate([a, b]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(work, "u bigint, v bigint")


def connected(edges: DataFrame) -> DataFrame:
    """``id, comp``: the smallest id that each id of the ``edges`` (``u``, ``v``) can reach, but for that one.

    Every step links the neighbours of each node to the smallest of them and shortens the way there; a node
    is one row per neighbour, never a list. Steps are written, so none is computed twice.
    """
    edges = stored(_larger_first(edges), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = _larger_first(larger)
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        joined = larger.join(least, "u")
        smaller = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        shorter = stored(_larger_first(smaller), "edges")
        forget(edges)
        edges = shorter
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = stored(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp")), "groups")
    forget(edges)
    return labels


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


class _Groups:
    """The component of each node that has one; every other node is its own."""

    def __init__(self):
        self.table: DataFrame | None = None

    def label(self, rows: DataFrame) -> DataFrame:
        if self.table is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(self.table, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def verify(self, pairs: DataFrame, sets: DataFrame, percent: int) -> bool:
        """Compare the pairs and take in those that link; whether there were any."""
        edges = stored(_verified(pairs, sets, percent), "links")
        some = not edges.isEmpty()
        if some:
            self.join(edges)
        forget(edges)
        return some

    def join(self, edges: DataFrame) -> None:
        """Take in links between nodes."""
        known = [edges]
        if self.table is not None:
            known.append(self.table.where("id != comp").select(F.col("id").alias("u"), F.col("comp").alias("v")))
        old, self.table = self.table, connected(reduce(DataFrame.unionByName, known))
        forget(old)


def _shared(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """The keys that two nodes or more show, for nodes with as many of them as a link must have."""
    w = F.expr("lag(id) over (partition by key order by id)"), F.expr("lead(id) over (partition by key order by id)")
    near = keys.select("key", "id", w[0].alias("before"), w[1].alias("after"))
    # a node can show a key twice if its row is there twice
    some = near.where("before != id or after != id").select("key", "id")
    some = stored(some, "shared")
    n_keys = some.groupBy("id").agg(F.count(F.lit(1)).alias("n_shared"))
    enough = n_keys.join(nodes.select("id", "n"), "id").where((F.col("n") <= SMALLEST + 1) | (F.col("n_shared") > _least_guard(F.col("n"))))
    shared = stored(some.join(enough.select("id", "n"), "id"), "shared")
    forget(some)
    return shared


def _least_guard(n):
    """The guard of the smallest set that can link with one of ``n`` shingles."""
    return _guard(F.ceil(n * 3 / 4))


def _pivot_pairs(labelled: DataFrame, turn: int) -> DataFrame:
    """For each node the pivot it shares most keys with.

    A key's pivot is the node whose keys are shared by most nodes; in later turns it is one of those that are
    not connected to that one, by a hash that changes with the turn.
    """
    sizes = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    central = labelled.join(sizes, "key").groupBy("id").agg(F.sum("k").alias("weight"))
    rows = labelled.join(central, "id")
    best = F.max(F.struct("weight", "id", "comp")).alias("head")
    heads = rows.groupBy("key").agg(best, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    if turn:
        rows = rows.join(heads.select("key", F.col("head.comp").alias("main")), "key").where("comp != main").drop("main")
        best = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("by"), "id", "comp")).alias("head")
        heads = rows.groupBy("key").agg(best)
    heads = heads.select("key", F.col("head.id").alias("pivot"), F.col("head.comp").alias("pivot_comp"))
    met = rows.join(heads, "key").where("comp != pivot_comp")
    counts = met.groupBy("id", "n", "pivot").agg(F.count(F.lit(1)).alias("c"))
    enough = counts.where((F.col("n") <= SMALLEST + 1) | (F.col("c") > _least_guard(F.col("n"))))
    best = enough.groupBy("id").agg(F.max(F.struct("c", "pivot")).alias("best"))
    return best.select(F.col("id").alias("u"), F.col("best.pivot").alias("v"))


def _open_keys(labelled: DataFrame) -> DataFrame:
    """The keys in which unconnected nodes meet, with whether they are ``costly`` and what a node has ``spared``."""
    cells = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    keys = cells.groupBy("key").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("within"))
    cross = (F.col("all") * F.col("all") - F.col("within")) / 2
    rows = labelled.join(keys.where(cross > 0).select("key", (cross > COSTLY).alias("costly")), "key")
    rows = stored(rows, "open")
    spared = rows.where("costly").groupBy("id").agg(F.count(F.lit(1)).alias("spared"))
    done = stored(rows.join(spared, "id", "left").withColumn("spared", F.coalesce("spared", F.lit(0))), "open")
    forget(rows)
    return done


def _crossed(rows: DataFrame, also: str = "true") -> DataFrame:
    """Pairs of unconnected nodes that meet in some key, with the number ``c`` of keys they share.

    ``also`` is a further condition on the meeting of the two sides, whose columns end in ``_v`` on the other.
    """
    other = {c: f"{c}_v" for c in rows.columns if c != "key"}
    met = rows.join(rows.select("key", *[F.col(k).alias(v) for k, v in other.items()]), "key")
    met = met.where("id < id_v and comp != comp_v and 4 * n >= 3 * n_v and 4 * n_v >= 3 * n").where(also)
    pairs = met.groupBy("id", "id_v", "n", "n_v", "spared", "spared_v").agg(F.count(F.lit(1)).alias("c"))
    return pairs.withColumnsRenamed({"id": "u", "id_v": "v"})


def _segment_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the open keys of the first index: pairs that share enough, and the nodes that lack keys to spare."""
    needed = F.least(_guard(F.col("n")), _guard(F.col("n_v")))
    enough = (F.col("c") + F.least("spared", "spared_v") > needed) | (F.least("n", "n_v") <= SMALLEST + 1)
    small = F.col("n") <= SMALLEST + 1
    risky = F.when(small, F.col("spared") > 0).otherwise(F.col("spared") > _least_guard(F.col("n")))
    return _crossed(rows.where("not costly")).where(enough).select("u", "v"), rows.where(risky).select("id").distinct()


def _shingle_pairs(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """From the open keys of the second index, which shows every shingle: pairs that may share enough of them.

    Two linked nodes share at least ``needed`` shingles, of which costly ones are at most what the one with
    fewer of them has. The second frame holds the pairs of nodes for which that is all of ``needed``.
    """
    needed = lambda n, m: F.ceil((n + m) * percent / (100 + percent))
    both = needed(F.col("n"), F.col("n_v"))
    cheap = _crossed(rows.where("not costly")).where(F.col("c") + F.least("spared", "spared_v") >= both)
    # the smallest node that this one meets in a costly key, and that is not too small to link with it
    low = F.ceil(F.col("n") * 3 / 4)
    costly = rows.where("costly")
    smallest = costly.groupBy("key").agg(F.min("n").alias("m"), F.count(F.lit(1)).alias("often"))
    costly = costly.join(smallest, "key")
    partner = costly.groupBy("id", "n", "spared").agg(F.min("m").alias("m"))
    least = needed(F.col("n"), F.greatest(F.col("m"), low))
    # Pairs that share a cheap key are above. The others share costly ones alone, `needed` of them at least, so
    # among the rarest of these, all but `needed` and one more, there is one that both have.
    stuck = partner.where(F.col("spared") >= least).select("id", (F.col("spared") - least + 1).alias("rarest"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "key"))
    shown = costly.drop("m").join(stuck, "id").withColumn("place", place).where("place <= rarest").drop("often", "rarest")
    bound = f"ceil((n + n_v) * {percent} / {100 + percent}) - 1"
    rest = _crossed(shown, f"place <= spared - ({bound}) and place_v <= spared_v - ({bound})")
    return cheap.select("u", "v"), rest.select("u", "v")


def jaccard_groups(docs: DataFrame, percent: int = 75, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, text_hash, n_shingles, component_id``, the smallest id that links can reach.

    Words are what stands between ASCII blanks, with A-Z in lower case; a set holds the distinct runs of
    five of them, or the whole sequence if there are fewer. NULL texts and texts without words have the
    empty set, link with nothing and keep their own id. Equal sets always link. Rows with equal ids are
    rows of one document, so their sets need not be equal. NULL ids come first in no order: a group with
    only NULL ids has a NULL component. ``percent`` must be 75 or more. Other columns are not read.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text")
    described = stored(_described(rows), "described")
    full = described.where("n > 0")
    rep = F.min(F.struct("doc_id", "text_hash"))
    nodes = full.groupBy("a", "b", "n").agg(rep.alias("rep"), F.min("doc_id").alias("least"))
    nodes = stored(numbered(nodes, ["a", "b", "n"], "id", "nodes"), "nodes")
    keyed = nodes.select("id", F.col("rep.doc_id").alias("of"), F.col("rep.text_hash").alias("hash"))
    same = full.join(keyed, full.doc_id.eqNullSafe(F.col("of")) & (full.text_hash == F.col("hash")))
    repeated = not same.groupBy("id").count().where("count > 1").isEmpty()

    groups = _Groups()
    shared = _shared(_keys(_texts_of(rows, nodes, repeated)), nodes)
    wanted = nodes.join(shared.select("id").distinct(), "id")
    sets = stored(_sets(_texts_of(rows, wanted, repeated)), "sets")
    for turn in range(PIVOT_ROUNDS):
        if not groups.verify(_pivot_pairs(groups.label(shared), turn), sets, percent):
            break
    rows_open = _open_keys(groups.label(shared))
    pairs, risky = _segment_pairs(rows_open)
    groups.verify(pairs, sets, percent)
    left = stored(risky, "risky")
    forget(shared, rows_open)
    if not left.isEmpty():
        _second_index(sets.join(left, "id", "left_semi"), groups, sets, percent)
    forget(sets, left)

    comps = groups.label(nodes).groupBy("comp").agg(F.min("least").alias("component_id"))
    labels = groups.label(nodes.select("id", "a", "b", "n")).join(comps, "comp").select("a", "b", "n", "component_id")
    out = described.join(labels, ["a", "b", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _second_index(risky: DataFrame, groups: _Groups, sets: DataFrame, percent: int) -> None:
    """Compare the nodes that lacked keys to spare among themselves, shingle by shingle."""
    rows = risky.select("id", "n", F.explode("shingles").alias("key"))
    times = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    shared = stored(rows.join(times, "key"), "shingle-keys")
    # a document that shares fewer shingles than a link takes is out
    own = shared.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    enough = shared.join(own, "id").where(F.col("own") >= F.ceil(F.col("n") * 3 / 4)).drop("own")
    rows = _open_keys(groups.label(enough))
    forget(shared)
    for pairs in _shingle_pairs(rows, percent):
        groups.verify(pairs, sets, percent)
    forget(rows)


def jaccard_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the digest of the query."""
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id, with the columns of ``docs``.

    Documents without words stay. Of repeated rows (equal id and text) one stays.
    """
    of, hash_of, text_hash = fresh(docs, "of", "hash_of", "text_hash")
    groups = stored(jaccard_groups(docs), "groups")
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = first.groupBy(F.col("doc_id").alias(of), F.col("text_hash").alias(hash_of)).agg(F.count(F.lit(1)).alias("times"))
    hashed = docs.withColumn(text_hash, F.coalesce(F.xxhash64("text"), F.lit(0)))
    kept = hashed.join(rows, hashed.doc_id.eqNullSafe(F.col(of)) & (F.col(text_hash) == F.col(hash_of)), "left_semi")
    if not rows.where("times > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", text_hash])
    return kept.drop(text_hash)


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), numbered AS (SELECT doc_id, hash(g) AS g FROM shingles
), sizes AS (SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM numbered a JOIN numbered b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, l.v FROM reach r JOIN both_ways l ON r.v = l.u
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN least ON u = d.doc_id
"""
