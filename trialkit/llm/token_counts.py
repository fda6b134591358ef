"""Greedy word-piece counts by a longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link and the number of tokens popped on the
way along it, both worked out beforehand, so a word is read once, from left to right, and its number of
longest-match pieces comes out in time linear in its length, without any piece being built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trialkit.llm.tokens import byte_names, text_runs

#: Words whose counts a task keeps; the store starts anew when it is full.
KEPT_WORDS = 500_000
KEPT_LENGTH = 64
#: Most bytes of a vocabulary that are sent to the tasks.
VOCABULARY_BYTES = 64_000_000
#: Stands after the last byte of a word.
END = 256

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read_pieces(path: str) -> list[tuple[bytes, bool]]:
    """Pieces of a tokenizer file with word ends: bytes, and whether the piece ends a word."""
    with open(path, encoding="utf-8") as file:
        raw = file.read()
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_BYTES} bytes")
    model = json.loads(raw)["model"]
    mark = model.get("end_of_word_suffix") or ""
    names = byte_names()
    pieces = []
    for name in model["vocab"]:
        last = bool(mark) and name.endswith(mark)
        body = name[: -len(mark)] if last else name
        if body and all(ch in names for ch in body):
            pieces.append((bytes(names[ch] for ch in body), last))
    return pieces


class LongestMatch:
    """Counts the greedy longest-match pieces of words.

    ``count`` gives 0 for an empty word, and -1 where some part of a word has no piece.
    """

    def __init__(self, pieces: Iterable[tuple[bytes, bool]]):
        self.next: list[dict[int, int]] = [{}]
        token = [False]
        for body, last in pieces:
            node = 0
            for symbol in [*body, END] if last else body:
                step = self.next[node].get(symbol)
                if step is None:
                    step = self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    token.append(False)
                node = step
            token[node] = node != 0
        # Breadth first: a token's link leads to the root and pops the token; another node's link is found
        # by following its parent's links until one can go on with the same symbol.
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        waiting = deque([0])
        while waiting:
            parent = waiting.popleft()
            for symbol, node in self.next[parent].items():
                waiting.append(node)
                if token[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, popped = self.link[parent], self.popped[parent]
                while at >= 0 and symbol not in self.next[at]:
                    popped += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.next[at][symbol], popped

    def count(self, word: bytes) -> int:
        nexts, links, pops = self.next, self.link, self.popped
        node = n = 0
        for symbol in word:
            while (step := nexts[node].get(symbol)) is None:
                if links[node] < 0:
                    return -1
                n += pops[node]
                node = links[node]
            node = step
        # the end of a word is a symbol of its own; a piece without it may also end here
        while node:
            step = nexts[node].get(END)
            if step is not None and not nexts[step]:
                return n + 1
            if links[node] < 0:
                return -1
            n += pops[node]
            node = links[node]
        return n


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``n_words``, ``n_tokens``, ``n_unknown`` words, ``most_tokens`` of one word.

    Words are what stands between ASCII blanks, with A-Z in lower case. Each has its number of greedy
    longest-match pieces; a word that the vocabulary cannot build counts as one token and is unknown. NULL
    and empty texts have zeros. Rows stay in their order and number; other columns are not read.
    """
    chosen = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary))
    names = ["n_words", "n_tokens", "n_unknown", "most_tokens"]
    schema = T.StructType([chosen.schema["doc_id"], *[T.StructField(k, T.LongType()) for k in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(pieces.value)
        kept: dict[bytes, int] = {}
        for batch in batches:
            out: list[list[int]] = []
            for _, run in text_runs(batch.column(1).to_pylist()):
                if len(kept) > KEPT_WORDS:
                    kept = {}
                for body in run:
                    # bytes.split() parts at the six ASCII blanks and no others
                    words = (body or "").encode().translate(_FOLD).split()
                    counts = list(map(kept.get, words))
                    if None in counts:
                        for i, n in enumerate(counts):
                            if n is None:
                                n = kept.get(words[i])
                                if n is None:
                                    n = automaton.count(words[i])
                                    if len(words[i]) <= KEPT_LENGTH:
                                        kept[words[i]] = n
                                counts[i] = n
                    unknown = counts.count(-1)
                    out.append([len(words), sum(counts) + 2 * unknown, unknown, max(map(abs, counts), default=0)])
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]]
            if out:
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return chosen.mapInArrow(work, schema)
