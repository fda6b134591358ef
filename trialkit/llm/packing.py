"""Sum-of-squares packing of tokenised documents into windows of a fixed length.

Whole windows are cut off long documents. What is left of a document goes online to the fill level that
keeps the sum of squares of the counts of partly filled windows, by level, smallest; the counts are a level
array. Each partition packs its own documents, so nothing is shuffled and a lost task is simply run again.
What stays partly filled at the end of a partition is cut together into full windows, and the last rest
into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trialkit.llm.tokens import RUN, read_tokenizer, text_runs, token_ids

WINDOW = 4096
#: Partly filled windows that a task keeps; beyond it they are cut together into full ones.
MOST_OPEN = 4096

Piece = tuple[object, int, bytes, int]  # document, first id, ids, ids of the document


class SumOfSquares:
    """Online packing into windows of ``size`` ids.

    ``levels[h]`` counts the open windows that hold ``h`` ids. A piece goes where the sum of the squares of
    the counts grows least; among equals, into the fullest window, and only then into a new one.
    """

    def __init__(self, size: int = WINDOW, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take a piece of fewer ids than a window; yields the windows that it fills."""
        n = len(piece[2]) // 4
        level = self._level(n)
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + n == self.size:
            yield window
            return
        self.open.setdefault(level + n, []).append(window)
        self.levels[level + n] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.close(rest=False)

    def _level(self, n: int) -> int:
        last = self.size - n
        before = self.levels[1 : last + 1]
        after = self.levels[1 + n : self.size + 1]
        # growth of the sum of squares: 2 (after - before) + 2, one less where the window becomes full
        growth = 2 * (after - before) + 2
        growth[-1] = 1 - 2 * before[-1]
        growth[before == 0] = np.iinfo(np.int64).max
        best = last - int(np.argmin(growth[::-1]))
        return best if growth[best - 1] <= 2 * self.levels[n] + 1 else 0

    def close(self, rest: bool = True) -> Iterator[list[Piece]]:
        """Cut the open windows together into full ones; the last rest into powers of two.

        Without ``rest`` the last rest stays open.
        """
        waiting = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        left = sum(len(p[2]) // 4 for w in waiting for p in w)
        window: list[Piece] = []
        room = want = self._want(left)
        for doc, start, ids, n in (p for w in waiting for p in w):
            while ids:
                part = ids[: 4 * room]
                window.append((doc, start, part, n))
                room -= len(part) // 4
                start += len(part) // 4
                ids = ids[len(part) :]
                if not room:
                    if want == self.size or rest:
                        yield window
                    else:
                        self._keep(window, want)
                    left -= want
                    window = []
                    room = want = self._want(left)

    def _want(self, left: int) -> int:
        return self.size if left >= self.size else 1 << max(left.bit_length() - 1, 0)

    def _keep(self, window: list[Piece], level: int) -> None:
        self.open.setdefault(level, []).append(window)
        self.levels[level] += 1
        self.n_open += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    window: int = WINDOW,
    pieces: str = "words",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents; one row per piece.

    ``doc_id``, ``start`` (ids of its document before the piece), ``length``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens`` (with the end id), ``sequence_id`` and
    ``offset`` there; with ``with_ids`` also the ``ids`` as bytes. A NULL or empty text is its end id
    alone. A NULL or repeated ``doc_id`` is packed like any other row. Sequence ids are the partition's
    number times 2**32 plus a counter. Other columns are not read. An empty table gives no rows.
    """
    chosen = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([chosen.schema["doc_id"], *[T.StructField(k, T.LongType()) for k in numbers]])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(spec.value, pieces, special=True)
        packer = SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        kind = None

        def put(pieces_of: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, n in pieces_of:
                length = len(ids) // 4
                row = (doc, start, length, zlib.crc32(ids), n, sequence, offset)
                rows.append((*row, ids) if with_ids else row)
                offset += length
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [kind, *[pa.int64()] * len(numbers), *[pa.binary()] * with_ids]
            done = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(done, schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in text_runs(texts, RUN):
                for i, ids in enumerate(tokens.encode(run), first):
                    ids += end
                    n = len(ids) // 4
                    start = 0
                    while n - start >= window:
                        put([(names[i], start, ids[4 * start : 4 * (start + window)], n)])
                        start += window
                    if start < n:
                        for full in packer.place((names[i], start, ids[4 * start :], n)):
                            put(full)
                if rows:
                    yield batch_of()
        for full in packer.close():
            put(full)
            if len(rows) >= 10_000:
                yield batch_of()
        if rows:
            yield batch_of()

    return chosen.mapInArrow(work, schema)
