"""Token ids of texts, word by word, by a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids are kept, and their bytes; the store starts anew when it is full.
KEPT_WORDS, KEPT_BYTES = 800_000, 40_000_000
#: Characters of the texts encoded by one call, at best: each word of theirs is looked up once.
RUN = 8_000_000
#: Words encoded by one call, and parts of words by one call of the tokenizer's model.
JOINED_WORDS, JOINED_PARTS = 20_000, 16

#: Words that both patterns cut into letters and the marks after them: nothing else in them is looked at.
_SIMPLE = "\\A(?P<body> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)\\z"
_INNER_BLANK = re.compile(r"(?<!^)\s|^[^\S ]|^ ?$")
#: Texts with other blanks than single spaces and line feeds between words.
BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = f"[\\x00\u180e{BLANKS}]|[ \n][ \n]|\\A[ \n]|[ \n]\\z|\\A\\z"


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text: it is read where the job is planned and sent along with it."""
    with open(path, encoding="utf-8") as file:
        return file.read()


class _Store:
    """Ids by word: those of all words in one array, with the place and the number of each word's."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = np.zeros(0, "<u4")
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, words: pa.Array) -> np.ndarray:
        """Numbers of the words, -1 for those that are not there."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, one word after the other, and where each word ends."""
        sizes = self.sizes.take(numbers)
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts.take(numbers) - (ends - sizes), sizes)
        places += np.arange(len(places))
        return self.ids.take(places), ends

    def full(self) -> bool:
        return len(self.words) > KEPT_WORDS or self.words.nbytes > KEPT_BYTES


class TokenIds:
    """Ids of whole texts, without special tokens, as little-endian unsigned 32-bit numbers.

    ``words``: the tokenizer drops blanks, so words between spaces and line feeds have ids of their own.
    ``spaces``: a space belongs to the word after it (the byte-level pattern), so pieces are cut before
    single spaces and around single line feeds, where that pattern always cuts; texts with other blanks
    are encoded as a whole. Either way the ids are those of the whole text, and a word that comes again is
    looked up. NULL and empty texts have no ids. With ``special`` the strings of special tokens that a text
    holds have the ids of these tokens, as a plain call of the tokenizer gives them.
    """

    def __init__(self, spec: str, pieces: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        if pieces not in ("words", "spaces"):
            raise ValueError("pieces must be 'words' or 'spaces'")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = not special  # or their strings in a text are ordinary text
        self.between = " | " if pieces == "words" else "\n|\n"
        self.mark = np.array(self._ids(f"a{self.between}a")[1:-1], "<u4")
        self.lower = pieces == "words"
        self.kept, self.parts = _Store(), _Store()
        names = {b: ch for ch, b in byte_names().items()}
        self.names = {b: names[b] for b in range(256)}
        model = self.tokenizer.model
        whole = isinstance(model, BPE) and not (model.end_of_word_suffix or model.continuing_subword_prefix or model.dropout or model.ignore_merges)
        #: The id of the zero byte, if words joined by it have the ids of their own.
        self.zero = model.token_to_id(self.names[0]) if whole else None

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if self.lower:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        # single spaces and line feeds between words, and no other blanks: both ways of cutting agree
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
        return pc.split_pattern(cut, "\x00")

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        if self.kept.full():
            self.kept = _Store()
        if self.parts.full():
            self.parts = _Store()
        column = pa.array([t or "" for t in texts], pa.large_string())
        found: list[bytes] = [b""] * len(texts)
        regular = np.arange(len(texts))
        if not self.lower:
            odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
            for i, ids in zip(np.flatnonzero(odd).tolist(), self._whole(column.filter(pa.array(odd)).to_pylist()), strict=True):
                found[i] = ids
            regular = np.flatnonzero(~odd)
            column = column.filter(pa.array(~odd))
        cut = self._cut(column)
        words = cut.flatten().dictionary_encode()
        ids, ends = self.kept.joined(self._numbers(words.dictionary).take(words.indices.to_numpy()))
        raw = memoryview(ids.tobytes())
        bounds = (4 * np.concatenate([[0], ends])[cut.offsets.to_numpy()]).tolist()
        for i, first, end in zip(regular.tolist(), bounds, bounds[1:], strict=False):
            found[i] = bytes(raw[first:end])
        return found

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of different words in the store, where new ones are entered."""
        numbers = self.kept.find(words)
        new = words.filter(pa.array(numbers < 0))
        if len(new):
            shapes = pc.extract_regex(new, _SIMPLE)
            simple = shapes.is_valid()
            base, places = len(self.kept.words), np.flatnonzero(numbers < 0)
            order = []
            some, shapes = new.filter(simple), shapes.filter(simple)
            if len(some):
                body = shapes.field("body")
                parts = np.stack([self._parts(pc.utf8_lower(body) if self.lower else body), self._parts(shapes.field("marks"))], 1)
                ids, ends = self.parts.joined(parts.ravel())
                self.kept.add(some, ids, np.diff(ends[1::2], prepend=0))
                order.append(np.flatnonzero(simple.to_numpy(zero_copy_only=False)))
            some = new.filter(pc.invert(simple))
            if len(some):
                each = self._whole(some.to_pylist())
                self.kept.add(some, np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64))
                order.append(np.flatnonzero(~simple.to_numpy(zero_copy_only=False)))
            numbers[places[np.concatenate(order)]] = base + np.arange(len(new))
        return numbers

    def _parts(self, parts: pa.Array) -> np.ndarray:
        """Numbers of parts of words in their store; the tokenizer's model encodes new ones.

        It takes what it is given as one word, so parts are joined by the zero byte; a merge with that byte would
        show in the number of its ids, and the parts are then encoded one by one.
        """
        parts = parts.dictionary_encode()
        numbers = self.parts.find(parts.dictionary)
        new = parts.dictionary.filter(pa.array(numbers < 0))
        if len(new):
            names = new.to_numpy(zero_copy_only=False).tolist()
            tokenize, ids, sizes = self.tokenizer.model.tokenize, [], None
            spell = lambda text: text.encode().decode("latin-1").translate(self.names)
            if self.zero is not None:
                for first in range(0, len(names), JOINED_PARTS):
                    ids += [t.id for t in tokenize(spell("\x00".join(names[first : first + JOINED_PARTS])))]
                    ids.append(self.zero)
                all_ids = np.array(ids, "<u4")
                ends = np.flatnonzero(all_ids == self.zero)
                if len(ends) == len(names):
                    sizes = np.diff(ends, prepend=-1) - 1
                    all_ids = all_ids[all_ids != self.zero]
            if sizes is None:
                each = [[t.id for t in tokenize(spell(name))] for name in names]
                sizes = np.array([len(x) for x in each], np.int64)
                all_ids = np.array([i for x in each for i in x], "<u4")
            numbers[numbers < 0] = len(self.parts.words) + np.arange(len(names))
            self.parts.add(new, all_ids, sizes)
        return numbers.take(parts.indices.to_numpy())

    def _whole(self, words: list[str]) -> list[bytes]:
        """The ids of some words by the whole tokenizer.

        A call for each of them would cost more than the encoding: they are joined by a separator that stays apart
        from them and whose ids no word without ``|`` (or, with spaces, without a line feed) can have.
        """
        done: dict[str, bytes] = {"": b""}
        plain, others = [], []
        for w in words:
            if w:
                (others if "|" in w or _INNER_BLANK.search(w) else plain).append(w)
        for first in range(0, len(plain), JOINED_WORDS):
            some = plain[first : first + JOINED_WORDS]
            # one more at the end, so that every word is followed by it
            ids = np.array(self._ids(self.between.join([*some, ""])), "<u4")
            mark = self.mark
            hit = ids[: len(ids) - len(mark) + 1] == mark[0]
            for k in range(1, len(mark)):
                hit &= ids[k : len(ids) - len(mark) + 1 + k] == mark[k]
            ends = np.flatnonzero(hit)
            if len(ends) != len(some):  # the tokenizer does not keep the separator apart
                others += some
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist(), strict=True):
                done[word] = raw[4 * start : 4 * end]
                start = end + len(mark)
        if others:
            encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
            for word, one in zip(others, encoded, strict=True):
                done[word] = array("I", one.ids).tobytes()
        return [done[w] for w in words]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def byte_names() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def token_ids(spec: str, pieces: str, special: bool = False) -> TokenIds:
    """A ``TokenIds`` that the tasks of a worker use one after the other, with the words it knows already."""
    key = (spec, pieces, special)
    if key not in _USED:
        _USED.clear()
        _USED[key] = TokenIds(*key)
    return _USED[key]


_USED: dict[tuple[str, str, bool], TokenIds] = {}


def text_runs(texts: Sequence[str | None], limit: int = 1_000_000):
    """Cut a list of texts into runs of about ``limit`` characters: (first, texts)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]
