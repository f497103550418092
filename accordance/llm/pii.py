"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and cue
words. At each anchor a local parser expands to the left and right, finds the boundaries and
validates (address parts, Luhn, IBAN remainder, digit counts). Time is linear in the text.

The base kinds (email, ip, card, phone) give the leftmost non-overlapping matches of their patterns,
of which those that fail validation are dropped. The further kinds are url, iban, ssn and secret
(the value after a cue word, or a key of a public format). Cue words count in any case. Null and empty texts have no spans; offsets count code points. Texts of any length are
searched whole, and each row for itself; an empty table gives no rows. ``find_pii`` reads no other columns, ``redact_pii`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "secret")
_ORDER = {kind: k for k, kind in enumerate(KINDS)}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}\Z")
_URL = re.compile(r"[^\s<>\"']+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LINE = re.compile(r"[\n\r]|[.!?](?=\s)")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}([\"']?)([^\s\"']{8,})")
# Beginnings of public key formats, in lower case, and the whole key.
KEYS = {
    "akia": re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "asia": re.compile(r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "ghp_": re.compile(r"(?<![A-Za-z0-9])ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xoxb-": re.compile(r"(?<![A-Za-z0-9])xoxb-[A-Za-z0-9-]{20,200}"),
    "-----begin": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]{0,20000}-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
}
#: Cue words, in any case, and what follows them: a secret at once, a number in the same line or sentence.
CUES = {
    "secret": ("password", "passwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "private_key"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
}

_found: list = []


def _automaton():
    """The worker's automaton."""
    if not _found:
        import ahocorasick

        made = ahocorasick.Automaton()
        for mark in ("@", "+", "://", *"0123456789"):
            made.add_word(mark, "digit" if mark.isdigit() else mark)
        for kind, words in CUES.items():
            for word in words:
                made.add_word(word, kind)
        for word in KEYS:
            made.add_word(word, word)
        made.make_automaton()
        _found.append(made)
    return _found[0]


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _number(kind: str, text: str, start: int, stop: int) -> tuple[int, int] | None:
    """Where the first valid number of this kind lies. An account may be followed by a word in capitals: its longest valid beginning counts."""
    for m in (_IBAN if kind == "iban" else _SSN).finditer(text, start, stop):
        if kind == "ssn":
            return m.span()
        for end in range(m.end(), m.start() + 14, -1):
            if text[end - 1] != " " and not text[end : end + 1].isalnum() and _iban(text[m.start() : end]):
                return m.start(), end
    return None


def _lower(text: str) -> str:
    """In lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what is found, by start, then kind."""
    out = []
    mail = ip = card = phone = url = run = other = 0  # where the next match of a kind may start
    none = {"iban": 0, "ssn": 0}
    for last, mark in _automaton().iter(_lower(text)):
        if mark == "digit":
            if last >= run:  # a new run of digits
                run = _DIGITS.match(text, last).end()
                if last >= ip and (m := _IP.match(text, last)):
                    ip = m.end()
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                        out.append(("ip", last, ip))
                if last >= card and (m := _CARD.match(text, last)):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "") if m.end() - last <= 40 else ""
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        out.append(("card", last, card))
        elif mark == "@":
            if last >= mail:
                start = last
                while start > mail and text[start - 1] in _LOCAL:
                    start -= 1
                if start < last and (m := _DOMAIN.match(text, last + 1)):
                    mail = m.end()
                    out.append(("email", start, mail))
        elif mark == "+":
            if last >= phone and (m := _PHONE.match(text, last)):
                phone = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", last, phone))
        elif mark == "://":
            if last >= url and (s := _SCHEME.search(text, max(url, last - 18), last - 2)) and (m := _URL.match(text, last + 1)):
                url = m.end()
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    out.append(("url", s.start(), end))
        elif mark in KEYS:
            if last >= other and (m := KEYS[mark].match(text, last + 1 - len(mark))):
                other = m.end()
                out.append(("secret", m.start(), other))
        elif last >= other:
            if mark == "secret":
                if m := _SECRET.match(text, last + 1):
                    other = m.end()
                    out.append(("secret", m.start(2), m.start(2) + len(m[2].rstrip(".,;"))))
            elif last >= none[mark]:
                stop = _LINE.search(text, last + 1)
                stop = stop.start() if stop else len(text)
                found = _number(mark, text, last + 1, stop)
                if found:
                    other = found[1]
                    out.append((mark, *found))
                else:
                    none[mark] = stop  # nor does a later cue of this line
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, at, merged = [], 0, []
    for kind, start, end in found:
        if merged and start < merged[-1][2]:
            merged[-1] = (merged[-1][0], merged[-1][1], max(end, merged[-1][2]))
        else:
            merged.append((kind, start, end))
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def _listed(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans (kind:start:end, comma-joined), for every row."""
    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [spans(t) for t in rows["text"]]
            base = [[s for s in x if s[0] in BASE] for x in found]
            counts = {f"n_{kind}": [sum(s[0] == kind for s in x) for x in base] for kind in BASE}
            yield pd.DataFrame({"doc_id": rows["doc_id"], **counts, "base_sha256": [hashlib.sha256(_listed(x).encode()).hexdigest() for x in base], "spans": [_listed(x) for x in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(answer, out)


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with what is found in ``text`` replaced; rows, order of columns and other columns stay. Null stays null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t if t is None else redact(t, spans(t)) for t in texts], dtype=object)

    return docs.withColumn(text, clean(F.col(text)))
