"""Token counts of every prefix of a text, by dynamic programming over the tokenizer's merges.

A list of tokens is what byte pair encoding makes of a string exactly if each two neighbours are
what it makes of their own two strings. So the encoding of a prefix ends with the one token t for
which the encoding of what comes before t ends with a token that t may follow, and its length is
one more than that of the shorter prefix. One pass over a piece gives the count at each prefix.

The tokens that end at a place come from an automaton of the vocabulary, the longest first, so a
piece of any length takes time in proportion to it. Where the normalizer composes characters, a
prefix that ends among them is counted from the state at the safe place before.

Counts are kept as one signed byte a character, the step from the prefix one shorter; the counts
are the running sums. Null texts are empty ones; the empty prefix has no tokens. Texts of any length are counted whole, and
each row for itself; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordance.llm.encoding import Kept, tokenizer_path

#: Characters that the normalizer keeps one for one (but for case), white space, and the split pattern for them.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_SPACES = re.compile("([\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+)")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\s|[^\sa-z0-9ß-öø-ÿ]+")

_counters: dict[str, "PrefixCounter"] = {}


def _byte_chars() -> list[str]:
    """The character that byte level models write for each byte: itself if it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _joins(char: str) -> bool:
    """If a normalizer may compose it with what is before: marks, and the later letters of Korean syllables."""
    return char >= "\u0300" and (unicodedata.category(char)[0] == "M" or "\u1160" <= char <= "\u11ff" or "\ud7b0" <= char <= "\ud7ff")


def _byte_ends(text: str) -> np.ndarray:
    """The bytes of each prefix."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))


def _steps(counts) -> bytes:
    return np.diff(counts).astype(np.int8).tobytes()


class PrefixCounter:
    """The counts of prefixes for a tokenizers file with a byte level byte pair model and a mark of word ends."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")" if self.special else "(?!)()")
        forms: dict[str, list] = {}  # of each string: its token inside a piece, and the one at the piece's end
        for token in set(model["vocab"]).difference(self.special):
            ended = bool(self.end) and token.endswith(self.end)
            form = forms.setdefault(token.removesuffix(self.end) if ended else token, [None, None])
            form[int(ended)] = token
            if not self.end:
                form[1] = token
        forms.pop("", None)
        self.longest = max(map(len, forms))
        self.automaton = ahocorasick.Automaton()
        # tokens have numbers from 1; 0 is what is before a piece, and the token that a string lacks
        self.names = [""]
        for text, pair in forms.items():
            numbers = []
            for token in pair:
                numbers.append(len(self.names) if token else 0)
                self.names += [token] if token else []
            self.automaton.add_word(text, (len(text), *numbers))
        self.automaton.make_automaton()
        self.follows: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.norms: dict[str, str] = {}
        self.chars = _byte_chars()
        spaced = lambda cuts: [b"\0" + self.steps(w) if w and not w[0].isspace() else self.steps(" " + w) for w in cuts]
        self.kept = Kept(lambda cuts: list(map(self.steps, cuts)), spaced, "i1")

    def merge(self, symbols: list[str]) -> list[str]:
        """Byte pair encoding of a few symbols."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.rank):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        """The characters of a token; a mark of the word's end belongs to its last one."""
        ended = bool(self.end) and token.endswith(self.end)
        chars = list(token[: len(token) - len(self.end)] if ended else token)
        return [*chars[:-1], chars[-1] + self.end] if ended else chars

    def _may_follow(self, left: int, right: int) -> bool:
        """If the model makes these two tokens of their strings together (of the right one's alone, at a piece's start)."""
        if len(self.follows) > 1_000_000:
            self.follows.clear()
        pair = [self.names[k] for k in (left, right) if k]
        fits = self.follows[left << 20 | right] = self.merge([x for token in pair for x in self._symbols(token)]) == pair
        return fits

    def _word(self, word: str, known: int = 0, last: list[int] | None = None, inside: list[int] | array | None = None) -> tuple:
        """For each k: the last token of word[:k] in the middle of a piece, how many it has there, and how many as a whole piece.

        ``word`` is in the model's own characters. ``last`` and ``inside`` may give what is ``known`` of the first ones.
        """
        numbers = list if len(word) < 10_000 else lambda x: array("q", x)
        last, inside, total = [0] if last is None else last, numbers([0]) if inside is None else inside, numbers([0])
        follows, may_follow = self.follows.get, self._may_follow
        now, token, n, whole = known, 0, -1, -1
        for end, (size, inner, final) in self.automaton.iter(word):
            if end != now:
                if end < known:
                    continue
                last.append(token)
                inside.append(n)
                total.append(whole)
                now, token, n, whole = end, 0, -1, -1
            if n < 0 and inner:
                at = end + 1 - size
                before = last[at]
                fits = follows(before << 20 | inner)
                if may_follow(before, inner) if fits is None else fits:
                    token, n = inner, inside[at] + 1
            if whole < 0 and final:
                at = end + 1 - size
                before = last[at]
                fits = follows(before << 20 | final)
                if may_follow(before, final) if fits is None else fits:
                    whole = inside[at] + 1
        last.append(token)
        inside.append(n)
        total.append(whole)
        return last, inside, total

    def _chars(self, text: str) -> str:
        return "".join(map(self.chars.__getitem__, text.encode()))

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> bytes:
        """The steps over a piece of the split pattern."""
        if text[0] == "'" and len(text) > 1 and text[1].isalpha():
            return _steps([self.count(text[:k]) for k in range(len(text) + 1)])  # a prefix of 're is cut otherwise
        if len(text) > 64:
            return self._piece(text)[0]
        total = self._word(self._chars(text))[2]
        if not text.isascii():
            at, all_, total = 0, total, [0]
            for c in text:
                at += len(c.encode())
                total.append(all_[at])
        return bytes([(b - a) & 255 for a, b in zip(total, total[1:])])

    def _piece(self, text: str) -> tuple[bytes, tuple, np.ndarray]:
        """The steps over a piece that isn't cut otherwise, what _longer needs, and the bytes of each prefix."""
        chars, ends = self._chars(text), _byte_ends(text)
        last, inside, total = self._word(chars)
        return _steps(np.array(total)[ends]), (chars, last, inside), ends

    def steps(self, cut: str) -> bytes:
        """The steps over the characters of a cut."""
        if not _PLAIN.fullmatch(cut) or "<|" in cut and any(s in cut for s in self.special):
            return self._odd_steps(cut)
        pieces, out = self.pieces, []
        for text in _PIECES.findall(cut.lower()):
            at = pieces.get(text)
            if at is None:
                at = b"\0" if text in " \t\n\r" else self.piece(text)
                if len(pieces) > 400_000:
                    pieces.clear()
                if len(text) <= 64:
                    pieces[text] = at
            out.append(at)
        return b"".join(out)

    def _odd_steps(self, cut: str) -> bytes:
        """As steps, by the library's own normalizer and split. A special token is plain text up to its last character."""
        out, before = [], ""
        for k, part in enumerate(self.specials.split(cut)):
            if k % 2:
                begun = self._runs(_SPACES.split(before)[-1] + part[:-1])[1 - len(part) :]
                out += [begun, _steps([np.frombuffer(begun, np.int8).sum(dtype=np.int64), 1])]
            else:
                out.append(self._runs(part))
                before = part
        return b"".join(out)

    def _runs(self, text: str) -> bytes:
        return b"".join(bytes(len(run)) if k % 2 else self._run(run) for k, run in enumerate(_SPACES.split(text)) if run)

    def _norm(self, text: str) -> str:
        if text not in self.norms:
            if len(self.norms) > 100_000:
                self.norms.clear()
            self.norms[text] = self.tokenizer.normalizer.normalize_str(text)
        return self.norms[text]

    def _run(self, run: str) -> bytes:
        """The steps over a run without white space."""
        safe = [0, *(k for k, c in enumerate(run) if k and not _joins(c)), len(run)]
        parts = [self._norm(run[a:b]) for a, b in zip(safe, safe[1:])]
        norm = "".join(parts)
        if norm != self.tokenizer.normalizer.normalize_str(run):  # composed over a place that seemed safe
            return _steps([self.count(run[:k]) for k in range(len(run) + 1)])
        pieces = [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]
        plain = len(parts) == len(run) == len(norm)
        long = {} if plain else {a: self._piece(norm[a:b]) for a, b in pieces if b - a > 64}
        steps = b"".join(long[a][0] if a in long else self.piece(norm[a:b]) for a, b in pieces)
        if plain:
            return steps
        done = np.append(0, np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)).tolist()
        counts, at, p = [0], 0, 0
        for a, b, part in zip(safe, safe[1:], parts):
            if b == a + 1:
                at += len(part)
                counts.append(done[at])
                continue
            while p + 1 < len(pieces) and pieces[p + 1][0] < at:
                p += 1
            first = pieces[p][0]
            if p and norm[pieces[p - 1][0] : first] == "'":  # it may be cut otherwise with other letters after it
                first = pieces[p - 1][0]
            for k in range(a + 1, b):  # prefixes that end among characters that compose
                more = self._norm(run[a:k])
                if at - first <= 64 or first not in long:
                    counts.append(done[first] + self.count(norm[first:at] + more))
                    continue
                # so long a piece has characters of one kind, of which ``more`` may begin with some
                joins = max(0, self.tokenizer.pre_tokenizer.pre_tokenize_str(norm[at - 2 : at] + more)[0][1][1] - 2)
                _, states, ends = long[first]
                n = self._longer(int(ends[at - first]), self._chars(more[:joins]), *states) if joins else done[at] - done[first]
                counts.append(done[first] + n + (self.count(more[joins:]) if more[joins:] else 0))
            at += len(part)
            counts.append(done[at])
        return _steps(counts)

    def _longer(self, upto: int, more: str, chars: str, last: list[int], inside: list[int] | array) -> int:
        """The count of chars[:upto] + more as a whole piece, from the states of ``chars``."""
        begin = max(0, upto - self.longest)
        return self._word(chars[begin:upto] + more, upto - begin, last[begin : upto + 1], inside[begin : upto + 1])[2][-1]

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The steps over each text."""
        return self.kept.each(texts)


def counter(path: str) -> PrefixCounter:
    """The worker's counter for this file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_steps(path: str) -> Column:
    """A function of a text column: the steps over its prefixes, as binary."""

    @F.pandas_udf(T.BinaryType())
    def steps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([s.tobytes() for s in counter(path).texts(texts.fillna("").tolist())])

    return steps


@F.pandas_udf(T.LongType())
def tokens_before(steps: pd.Series, n_chars: pd.Series) -> pd.Series:
    """Tokens of the prefix of so many characters, from its text's steps."""
    return pd.Series([int(np.frombuffer(s, np.int8)[: max(0, n)].sum(dtype=np.int64)) for s, n in zip(steps, n_chars)])


@F.pandas_udf(T.LongType())
def longest_within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix of at most so many tokens, from its text's steps."""
    out = []
    for s, most in zip(steps, budget):
        fits = np.flatnonzero(np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64) <= most)
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pd.Series(out)


def count_tokens(docs: DataFrame, limit: int = 2048, tokenizer: str = "word_bpe_49k.json", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and limit_chars (the longest prefix within the limit) of each row.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids are answered row by row.
    """
    path = tokenizer_path(tokenizer)
    out = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long"

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            total, fits = [], []
            for steps in counter(path).texts(rows["text"].tolist()):
                counts = np.cumsum(steps, dtype=np.int64)
                total.append(int(counts[-1]) if len(counts) else 0)
                fits.append(len(counts) if total[-1] <= limit else int(np.flatnonzero(np.append(0, counts) <= limit)[-1]))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": total, "over_limit": [n > limit for n in total], "limit_chars": fits})

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    return rows.mapInPandas(answer, out)
