"""Token ids by a public tokenizer file, with a bounded memory of the words seen before.

A text is cut at every single space between two characters that aren't white space. The split
patterns of these tokenizers never match across such a place (a space only ever leads a piece
there), so the ids of the text are those of its cuts in a row. Arrow splits a chunk of texts and
numbers its different cuts; each goes through the tokenizers library once and its ids are kept in
one flat array, from which the ids of all texts are gathered at once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Spaces that a text isn't cut at.
_HELD = re.compile(r"(?<!\S) | (?!\S)")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A word with marks after it, perhaps over a line end to a next word; no split pattern matches across their edges.
_PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*(?:\n(?!\n))?)([A-Za-zÀ-ÖØ-öø-ÿ]*)")
#: Cuts that a worker keeps, and the longest that is kept.
KEPT, LONGEST = 500_000, 64
#: Characters of the texts that are handled at once.
CHUNK_CHARS = 3_000_000

_encoders: dict[tuple[str, str], "Encoder"] = {}


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of about CHUNK_CHARS, cut before a space that it can be cut at."""
    at = 0
    while len(text) - at > CHUNK_CHARS and (cut := _CUT.search(text, at + CHUNK_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _chunks(texts: list[str]) -> Iterator[list[tuple[str, bool]]]:
    """The parts of the texts in order, and if they are a text's last, in lists of about CHUNK_CHARS characters."""
    chunk, size = [], 0
    for text in texts:
        for part in _parts(text):
            if chunk and size + len(part) > CHUNK_CHARS:
                yield chunk
                chunk, size = [], 0
            chunk.append((part, False))
            size += len(part)
        chunk[-1] = chunk[-1][0], True
    if chunk:
        yield chunk


class Kept:
    """The items (ids, or steps) of words, in one flat array. ``first`` makes those of words that begin a text, ``spaced``
    those of words with the space before them; only the latter are kept."""

    def __init__(self, first: Callable[[list[str]], list[bytes]], spaced: Callable[[list[str]], list[bytes]], dtype: np.dtype):
        self.make_first, self.make_spaced, self.dtype = first, spaced, np.dtype(dtype)
        self.number: dict[str, int] = {}
        self.flat, self.end = np.zeros(1 << 16, self.dtype), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _append(self, items: list[bytes]) -> None:
        """More entries at the end of the table."""
        size = np.fromiter(map(len, items), np.int64, len(items)) // self.dtype.itemsize
        total = int(size.sum())
        if self.end + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.end], np.zeros(max(len(self.flat), total), self.dtype)])
        self.flat[self.end : self.end + total] = np.frombuffer(b"".join(items), self.dtype)
        self.start = np.append(self.start, self.end + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.end += total

    def _forget(self) -> None:
        """Keeps the half that was used most."""
        keep = np.sort(np.argpartition(-self.uses, KEPT // 2)[: KEPT // 2])
        at, _ = self._at(keep)
        words = list(self.number)
        self.number = {words[k]: new for new, k in enumerate(keep.tolist())}
        self.flat, self.size, self.uses = self.flat[at], self.size[keep], self.uses[keep] // 2
        self.start, self.end = np.cumsum(self.size) - self.size, len(at)

    def known(self, words: set[str]) -> dict[str, bytes]:
        """The items of those words that are kept."""
        found = list(words & self.number.keys())
        at, ends = self._at(np.fromiter((self.number[w] for w in found), np.int64, len(found)))
        raw, ends = self.flat[at].tobytes(), (ends * self.dtype.itemsize).tolist()
        return {w: raw[a:b] for w, a, b in zip(found, [0, *ends], ends)}

    def _at(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the flat array the items of these entries lie, and where those of each entry end."""
        size = self.size[entries]
        ends = np.cumsum(size)
        return np.repeat(self.start[entries] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0), ends

    def items(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The items of some texts (a chunk), one text's after another's, and the len(texts) + 1 bounds between them."""
        if len(self.number) > KEPT:
            self._forget()
        words, odd, index, bounds = _split(texts)
        if odd.any():  # spaces beside other white space get another character while the texts are cut
            which = np.flatnonzero(np.logical_or.reduceat(odd[index], bounds[:-1])).tolist()
            mark = next(c for c in map(chr, range(0xE000, 0xF900)) if not any(c in texts[k] for k in which))
            texts = texts.copy()
            for k in which:
                texts[k] = _HELD.sub(mark, texts[k])
            words, _, index, bounds = _split(texts)
            words = [w.replace(mark, " ") if mark in w else w for w in words]
        of = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        later = np.ones(len(index), dtype=bool)
        later[bounds[:-1]] = False
        missing = np.flatnonzero((of < 0) & (np.bincount(index[later], minlength=len(words)) > 0))
        passing = np.fromiter((len(w := words[k]) > LONGEST or not w or w[-1].isspace() for k in missing), bool, len(missing))
        new, once = missing[~passing], missing[passing]
        of[new] = np.arange(len(new)) + len(self.number)
        fresh = [words[k] for k in new]
        self._append(self.make_spaced(fresh))
        self.number.update(zip(fresh, of[new].tolist()))
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        stay = len(self.size), self.end
        of[once] = np.arange(len(once)) + len(self.size)
        self._append(self.make_spaced([words[k] for k in once]))
        entries = of[index]
        entries[~later] = np.arange(len(texts)) + len(self.size)
        self._append(self.make_first([words[k] for k in index[~later]]))
        self.uses += np.bincount(entries[later], minlength=len(self.uses))[: len(self.uses)]
        at, ends = self._at(entries)
        found = self.flat[at]
        self.start, self.size, self.end = self.start[: stay[0]], self.size[: stay[0]], stay[1]
        return found, np.append(0, np.append(0, ends)[bounds[1:]])


    def each(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The items of each text."""
        before: list[np.ndarray] = []
        for chunk in _chunks(texts):
            flat, bounds = self.items([part for part, _ in chunk])
            bounds = bounds.tolist()
            for (_, last), a, b in zip(chunk, bounds, bounds[1:]):
                before.append(flat[a:b])
                if last:
                    yield np.concatenate(before) if len(before) > 1 else before[0]
                    before = []


def _split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The different parts between the spaces of the texts, which of them white space begins or ends (or nothing is in),
    which of them follow one another, and where each text's begin."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    parts = lists.flatten().dictionary_encode()
    words = parts.dictionary
    odd = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(words), words), pc.equal(words, "")).to_numpy(zero_copy_only=False)
    return words.to_numpy(zero_copy_only=False).tolist(), odd, parts.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)


class Encoder:
    """Ids of texts as numbers of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.dtype = np.dtype(dtype)
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        if max(vocab.values()) > np.iinfo(self.dtype).max:
            raise ValueError(f"ids of {path} don't fit {dtype}")
        # which ids end a word (where words have a mark at their end), or begin one (where the space does)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends, self.edge = bool(suffix), np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith(suffix) if suffix else t.startswith("\u0120"))]] = True
        one = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = one[0] if len(one) == 1 else -1
        self.kept = Kept(self._encode, self._spaced, self.dtype)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _many(self, words: list[str], between: str) -> dict[str, bytes]:
        """Of different words of letters: each is one piece to the tokenizer, so they go many at a time, with a space before each
        or, for words without one, with line ends between them."""
        found = {}
        for begin in range(0, len(words), 1000):
            part = words[begin : begin + 1000]
            ids = np.array(self.tokenizer.encode(between + between.join(part), add_special_tokens=False).ids, dtype=self.dtype)
            if between == " ":
                at = np.flatnonzero(self.edge[ids]) + self.ends
                at = np.append(0, at) if self.ends else np.append(at, len(ids))
                starts = at[:-1]
            else:
                at = np.append(np.flatnonzero(ids == self.line), len(ids))
                starts = at[:-1] + 1
            if len(at) == len(part) + 1:
                raw, width = ids.tobytes(), self.dtype.itemsize
                found.update((w, raw[a:b]) for w, a, b in zip(part, (starts * width).tolist(), (at[1:] * width).tolist()))
            else:
                found.update(zip(part, self._encode([w if between == "\n" else " " + w for w in part])))
        return found

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Of cuts with the space before them. Those of letters and marks are put together of their parts' ids."""
        parts = {w: m.groups() for w in words if len(w) <= LONGEST and (m := _PARTS.fullmatch(w))}
        lead, later = {p[0] for p in parts.values()}, {p[2] for p in parts.values()}
        if self.ends:  # the space makes no difference
            lead, later = lead | later, set()
        known = self.kept.known(lead)
        known |= self._many([w for w in lead if w and w not in known], " ")
        bare = known if self.ends else self._many([w for w in later if w], "\n")
        marks = list({p[1] for p in parts.values()})
        tail = dict(zip(marks, self._encode(marks)))
        rest = [w for w in words if w not in parts]
        found = dict(zip(rest, self._encode([" " + w for w in rest])))
        found.update((w, known[a] + tail[m] + bare[b] if b else known[a] + tail[m]) for w, (a, m, b) in parts.items())
        return [found[w] for w in words]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return self.kept.each(texts)


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """The worker's encoder for this file; it lives as long as the worker."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
