"""SentencePiece encoding and decoding of merge-type models, exact and without the library's own encoder.

Merging joins, of all neighbours that make a piece together, those with the best score, the leftmost of equal ones. A row of
pieces is what merging makes of a string exactly if it makes each piece, and each two neighbours, of their own strings: a
merge across a place where two pieces meet would happen in the two alone as well. So encoding is a search. At each place the
longest piece that begins there (an automaton of the vocabulary finds them) is tried, then the shorter ones that it begins
with; one is taken if merging its string and the one before gives the two again, which is remembered. Where none fits, the
place is marked in a bit field as failed, the piece before it is taken back and a shorter one tried in its stead. The row
of pieces up to a place is unique, so a failed place is never tried again and the time is in proportion to the text.

A model's pieces have the mark of a space at most at their beginning, so texts are encoded word by word (encoding.Kept).
Characters without a piece become those of their UTF-8 bytes. Null texts are empty ones, empty texts have no ids. Texts of
any length are encoded whole, and each row for itself, repeated ones and null ids too; an empty table gives no rows. Other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm.encoding import LONGEST, Kept, _parts, tokenizer_path

SPACE = "▁"  # the model's mark of a space
# The kinds of a model's pieces, and what an unknown piece reads as.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_TEXT = " ⁇ "
NEVER = float("-inf")
#: Pairs of pieces whose fit a worker remembers, and ids that are written or read at once.
MAX_PAIRS, AT_ONCE = 1_000_000, 1 << 18
#: A run of letters or of other characters; so many are kept.
_RUNS = re.compile(r"[^\W\d_¹²³]+|[\W\d_¹²³]+")
MAX_RUNS = 300_000

_codecs: dict[str, "PieceCodec"] = {}


def _valid(data: bytes) -> str:
    """The bytes as text; each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


class PieceCodec:
    """Ids of texts and texts of ids, for a model file of the merge type with byte pieces, no normalisation and a space put before each text."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        whole = all(c in self.scores and c != "\0" for name in self.scores for c in name) and not any(re.search(f"[^{SPACE}]{SPACE}", name) for name in self.scores)
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain or not whole or not {*self.kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: only merge-type models with byte pieces, plain text and spaces at the beginning of pieces")
        number = {name: i for i, name in enumerate(self.names) if self.kinds[i] == NORMAL}
        self.byte = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte[int(self.names[i][1:-1], 16)] = i
        self.wide = len(self.names) > 1 << 16
        self.size = [len(name) for name in self.names]
        self.automaton = ahocorasick.Automaton()
        for name, i in number.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        # of each piece the longest shorter one that it begins with; 0, the unknown piece's id, is none
        self.shorter = [0] * len(self.names)
        for name, i in number.items():
            self.shorter[i] = next((number[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in number), 0)
        self.fits: dict[int, bool] = {}
        self.apart = all(len(_RUNS.findall(name.lstrip(SPACE))) <= 1 for name in number)
        self.known: dict[str, bytes] = {}
        self.decimal = list(map(str, range(len(self.names))))
        texts = {NORMAL: lambda i: self.names[i].replace(SPACE, " ").encode(), UNKNOWN: lambda i: UNKNOWN_TEXT.encode(), CONTROL: lambda i: b"", BYTE: lambda i: bytes([int(self.names[i][1:-1], 16)])}
        self.bytes = [texts[kind](i) for i, kind in enumerate(self.kinds)]
        # a word that begins a text has a space put before it, as any other has one
        self.kept = Kept(lambda words: [ids if w else b"" for w, ids in zip(words, self._spaced(words))], self._spaced, "<u4" if self.wide else "<u2")

    def merge(self, text: str) -> list[str]:
        """What merging makes of a few characters."""
        symbols, score = list(text), self.scores.get
        pairs = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) > NEVER:
            k = pairs.index(best)
            symbols[k] += symbols.pop(k + 1)
            del pairs[k]
            if k:
                pairs[k - 1] = score(symbols[k - 1] + symbols[k], NEVER)
            if k < len(pairs):
                pairs[k] = score(symbols[k] + symbols[k + 1], NEVER)
        return symbols

    def _may_follow(self, left: int, right: int) -> bool:
        """If merging the strings of both gives these two again (of the right one's alone, where ``left`` is 0)."""
        if len(self.fits) > MAX_PAIRS:
            self.fits.clear()
        pair = [self.names[i] for i in (left, right) if i]
        found = self.fits[left * len(self.names) + right] = self.merge("".join(pair)) == pair
        return found

    def search(self, words: list[str]) -> list[bytes]:
        """The ids of strings in which spaces are marked, each for itself."""
        text = "".join("\0" + word for word in words)  # no piece has the character between them
        n, size, shorter, fits, count = len(text), self.size, self.shorter, self.fits.get, len(self.names)
        longest = [0] * (n + 1) if n < 1 << 16 else array("i", bytes(4 * n + 4))
        for end, i in self.automaton.iter(text):
            longest[end + 1 - size[i]] = i  # of pieces with one beginning the longest comes last
        at = 0
        for word in words:
            longest[at] = -1
            at += len(word) + 1
        out, starts, failed, any_failed = array("I" if self.wide else "H"), [], bytearray(n // 8 + 1), False
        at, begin, last, token = 0, 0, 0, longest[0]
        while at < n:
            if token < 0:  # a string begins after this
                starts.append(len(out))
                begin = at = at + 1
                last, token = 0, longest[at]
            elif token:
                end = at + size[token]
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    fit = fits(last * count + token)
                    if self._may_follow(last, token) if fit is None else fit:
                        out.append(token)
                        at, last, token = end, token, longest[end]
                        continue
                token = shorter[token]
            elif longest[at]:
                any_failed = True
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= size[token]
                last = out[-1] if at > begin else 0
            else:  # no piece has this character, so none is merged across it
                out.extend(self.byte[b] for b in text[at].encode())
                at, last = at + 1, 0
                begin, token = at, longest[at]
        starts.append(len(out))
        return [out[a:b].tobytes() for a, b in zip(starts, starts[1:])]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words with a space before each; runs of letters and of other characters, which no piece joins, are known apart."""
        split = [[w] if " " in w or not self.apart else _RUNS.findall(w) or [""] for w in words]
        runs = [[SPACE + first.replace(" ", SPACE), *rest] for first, *rest in split]
        if len(self.known) > MAX_RUNS:
            self.known.clear()
        fresh = sorted({run for word in runs for run in word}.difference(self.known))
        begin, held = 0, 0
        for k, run in enumerate(fresh, 1):
            held += len(run)
            if held >= 4096 or k == len(fresh):
                self.known.update(zip(fresh[begin:k], self.search(fresh[begin:k])))
                begin, held = k, 0
        found = [b"".join(map(self.known.__getitem__, word)) for word in runs]
        for run in fresh:
            if len(run) > LONGEST:
                del self.known[run]
        return found

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        parts, ends = [], []
        for text in texts:  # a later part of a long text comes without the space before it, which each part gets anew
            parts += [part[1:] if k else part for k, part in enumerate(_parts(text.replace(SPACE, " ")))]
            ends.append(len(parts))
        found, done = self.kept.each(parts), 0
        for end in ends:
            ids = [next(found) for _ in range(end - done)]
            done = end
            yield ids[0] if len(ids) == 1 else np.concatenate(ids)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: without the space before it, byte pieces read as UTF-8, control pieces as nothing."""
        ids = list(ids)
        data = b"".join(map(self.bytes.__getitem__, ids))
        first = next((i for i in ids if self.bytes[i]), 0)
        lead = int(self.kinds[first] == NORMAL and data.startswith(b" "))
        try:
            if not any(self.kinds[i] == CONTROL for i in {*ids}):  # one parts the bytes before it from those after it
                return data[lead:].decode()
        except UnicodeDecodeError:
            pass
        out, run = [], b""
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.bytes[i]
                continue
            out += [_valid(run), self.bytes[i].decode()]
            run = b""
        return "".join([*out, _valid(run)])[lead:]

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The UTF-8 text of ids that ``encode`` gave, in parts."""
        for begin in range(0, len(ids), AT_ONCE):
            part = b"".join(map(self.bytes.__getitem__, ids[begin : begin + AT_ONCE].tolist()))
            yield part if begin else part[1:]

    def written(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids in decimals, joined by commas, in parts."""
        for begin in range(0, len(ids), AT_ONCE):
            part = ",".join(map(self.decimal.__getitem__, ids[begin : begin + AT_ONCE].tolist())).encode()
            yield b"," + part if begin else part


def codec(path: str) -> PieceCodec:
    """The worker's codec for this file; it lives as long as the worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(tokenizer: str = "piece_bpe_32k.model"):
    """A function of a text column: its ids, an array of ints."""
    path = tokenizer_path(tokenizer)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([ids.astype(np.int32) for ids in codec(path).encode(texts.fillna("").tolist())])

    return encode


def decode_pieces(tokenizer: str = "piece_bpe_32k.model"):
    """A function of a column of ids: their text; null for null."""
    path = tokenizer_path(tokenizer)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([None if ids is None else codec(path).decode(ids) for ids in lists])

    return decode


def piece_digests(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimals, joined by commas) and decoded_sha256 (of the text decoded from them) of each row."""
    path = tokenizer_path(tokenizer)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for rows in batches:
            found = []
            for ids in own.encode(rows["text"].tolist()):
                sums = hashlib.sha256(), hashlib.sha256()
                for digest, parts in zip(sums, (own.written(ids), own.decoded(ids))):
                    for part in parts:
                        digest.update(part)
                found.append((len(ids), *(s.hexdigest() for s in sums)))
            n, a, b = zip(*found) if found else ((), (), ())
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(answer, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
