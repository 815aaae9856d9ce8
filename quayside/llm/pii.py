"""Personal data with offset-preserving deobfuscation.

Two passes over every whole text. The base pass finds e-mail addresses, IPv4 addresses,
card numbers and phone numbers as they stand. The second pass rewrites disguises
(look-alike letters and digits, invisible characters, digits spelled as words, written-out
at signs and dots) by small transducers. Each transducer keeps, for every character it
writes, the source characters it stands for, so a match in the rewritten text maps back to
a span of the source. Spans of the second pass that touch no base span are added; base
spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import Spans, documents, map_texts

KINDS = ("email", "ip", "card", "phone")

# Characters of other scripts that look like a Latin letter or digit.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "。": ".", "․": ".", "⁺": "+",
}
INVISIBLE = "­​‌‍⁠﻿"
# Digit words (English, German, French, Spanish).
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arobase", "arroba", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "point", "punto")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds and possessive repeats keep long digit runs linear; a match can only
# begin where a run begins, so they find what the plain patterns find.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(t: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = t.find("@")
    while at >= 0:
        left = at
        while left > free and t[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(t, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
            free = m.end()
        at = t.find("@", max(at + 1, free))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_base(t: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in the text as it stands, leftmost and not overlapping."""
    found: dict[str, list[tuple[int, int]]] = {"email": _emails(t), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and _luhn(d):
                found["card"].append(m.span())
    if "+" in t:
        found["phone"] = [m.span() for m in _PHONE.finditer(t) if 8 <= len(_digits(m.group())) <= 15]
    return found


# -- transducers -----------------------------------------------------------------------

class Tape:
    """A rewritten text that knows which source span each of its characters stands for. Kept
    are the edits and the tape they were made on, so it grows with the edits only."""

    def __init__(self, text: str, under: Tape | None = None, edits: list[tuple[int, int, str]] = ()):
        self.text, self.under, self.edits, self.starts, shift = text, under, edits, [], 0
        for s, e, new in edits:
            self.starts.append(s + shift)
            shift += len(new) - (e - s)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace the (sorted, disjoint) spans; each new character stands for the whole
        replaced span."""
        text, at = [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            at = e
        return Tape("".join([*text, self.text[at:]]), self, edits)

    def _below(self, i: int) -> tuple[int, int]:
        """The span of the tape below that character i stands for."""
        k = bisect_right(self.starts, i) - 1
        if k < 0:
            return i, i + 1
        s, e, new = self.edits[k]
        past = i - self.starts[k] - len(new)
        return (s, e) if past < 0 else (e + past, e + past + 1)

    def source(self, s: int, e: int) -> tuple[int, int]:
        if self.under is None:
            return s, e
        a, b = self._below(s)[0], self._below(e - 1)[1]
        return self.under.source(a, a + 1)[0], self.under.source(b - 1, b)[1]


def _plain(c: str) -> str | None:
    """What a disguised character stands for, or None if it is no disguise."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    if c.isdigit() and not c.isascii() and (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded != c and len(folded) == 1 and "!" <= folded <= "~" else None


@lru_cache(maxsize=4096)
def _plain_of(c: str) -> str | None:
    return _plain(c)


def look_alikes(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    known = {c: p for c in set(tape.text) if not c.isascii() and (p := _plain_of(c)) is not None}
    if not known:
        return tape
    cls = re.compile("[" + re.escape("".join(known)) + "]")
    return tape.rewrite([(m.start(), m.end(), known[m.group()]) for m in cls.finditer(tape.text)])


_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GAP = r"[\x20\t,.\-]{1,3}"
_DOT = rf"(?:\s{{0,3}}[\[({{<]\s{{0,3}}(?:{'|'.join(DOT_WORDS)}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|\s{{1,3}}(?:{'|'.join(DOT_WORDS)})\s{{1,3}})"
_ITEM = rf"(?:{_NUMBER}|[0-9]++)(?!\w)"
_SPELLED = re.compile(rf"(?<!\w)(?:plus{_GAP})?{_ITEM}(?:(?:{_DOT}|{_GAP}){_ITEM})+", re.I)
_DOT_RE = re.compile(_DOT, re.I)
_BRACKET_DOT = re.compile(r"[\[({<]\s{0,3}\.")
_ONE = re.compile(rf"(?<!\w)(?:plus|{_NUMBER}|[0-9]+)(?!\w)", re.I)
_SURE = ("three", "five", "seven", "eight", "four", "nine", "six", "two", "zero", "sieben", "acht", "fünf", "drei",
         "vier", "neun", "zwei", "sechs", "cinq", "quatre", "huit", "sept", "deux", "trois", "siete", "ocho", "cinco",
         "cuatro", "nueve", "tres", "dos", "one", "eins", "uno")


def spelled_digits(tape: Tape, low: str) -> Tape:
    """Digit words and digit groups in a row become their digits, the gaps between them go;
    written dots between them become dots. Runs of digits alone keep their gaps."""
    if not any(w in low for w in (*_SURE, *DOT_WORDS)) and not _BRACKET_DOT.search(low):
        return tape
    edits = []
    for m in _SPELLED.finditer(tape.text):
        found = list(_ONE.finditer(tape.text, m.start(), m.end()))
        spelled = any(w.group()[0].isalpha() for w in found)
        at = m.start()
        for w in found:
            if w.start() > at:
                if _DOT_RE.fullmatch(tape.text, at, w.start()):
                    edits.append((at, w.start(), "."))
                elif spelled:
                    edits.append((at, w.start(), ""))
            word = w.group().lower()
            if word[0].isalpha():
                edits.append((w.start(), w.end(), "+" if word == "plus" else DIGIT_WORDS[word]))
            at = w.end()
    return tape.rewrite(edits) if edits else tape


_LABEL = r"[A-Za-z0-9-]{1,63}"
_AT = rf"(?:\s{{0,3}}[\[({{<]\s{{0,3}}(?:{'|'.join(AT_WORDS)}|@|a)\s{{0,3}}[\])}}>]\s{{0,3}}|\s{{1,3}}(?:{'|'.join(AT_WORDS)})\s{{1,3}}|\s{{0,3}}@\s{{0,3}})"
_AT_RE = re.compile(_AT, re.I)
# what follows a disguised at sign: labels parted by real or written dots
_AFTER_AT = re.compile(rf"{_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{1,8}}", re.I)


def written_signs(tape: Tape, low: str) -> Tape:
    """``name at host dot com`` and its bracketed forms become ``name@host.com``. A bare
    word "at" counts only if a written dot follows in the host part."""
    if not any(w in low for w in (*DOT_WORDS, "[", "(", "{", "<", " @", "@ ")):
        return tape
    t, edits, at = tape.text, [], 0
    while m := _AT_RE.search(t, at):
        at = m.end()
        host = _AFTER_AT.match(t, m.end())
        if host is None or m.start() == 0 or t[m.start() - 1] not in _LOCAL:
            continue
        dots = list(_DOT_RE.finditer(t, host.start(), host.end()))
        sign = m.group().strip()
        if not dots and (sign == "@" or sign[0] not in "[({<"):
            continue
        # names in front of the sign may hold written dots, too
        left = m.start()
        while (d := re.search(rf"{_DOT}[A-Za-z0-9_%+-]{{1,64}}$", t[max(0, left - 100):left], re.I)) and d.start() + max(0, left - 100) > (edits[-1][1] if edits else 0):
            left = d.start() + max(0, left - 100)
            if left == 0 or t[left - 1] not in _LOCAL:
                break
        front = [(d.start(), d.end(), ".") for d in _DOT_RE.finditer(t, left, m.start())]
        edits += [*front, (m.start(), m.end(), "@"), *((d.start(), d.end(), ".") for d in dots)]
        at = host.end()
    return tape.rewrite(edits) if edits else tape


def find_hidden(t: str, base: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of disguised identifiers that touch no base span."""
    tape = look_alikes(Tape(t)) if _disguised(t) else Tape(t)
    low = tape.text.lower()
    tape = spelled_digits(tape, low)
    tape = written_signs(tape, low)
    if tape.text == t:
        return []
    taken = Spans(base)
    return [(kind, *span) for kind, spans in find_base(tape.text).items() for span in taken.take_free(tape.source(s, e) for s, e in spans)]


def _disguised(t: str) -> bool:
    return not t.isascii() and any(_plain_of(c) is not None for c in set(t) if not c.isascii())


def find_all(t: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    base = find_base(t)
    spans = [s for k in KINDS for s in base[k]]
    return base, [(k, *s) for k in KINDS for s in base[k]] + find_hidden(t, spans)


def _line(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def pii_spans(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the key, the base counts ``n_email n_ip n_card n_phone``, ``base_sha256``
    over the base spans, ``spans`` (base and recovered, ``kind:start:end`` by kind, then
    start; code points, end exclusive) and ``n_hidden``, the number of recovered ones.

    Null texts count as empty (no spans); repeated rows stay; other columns are ignored;
    texts of any length are read whole.
    """
    def fn(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_hidden")}
        for t in texts:
            base, spans = find_all(t)
            n = 0
            for k in KINDS:
                out[f"n_{k}"].append(len(base[k]))
                n += len(base[k])
            out["base_sha256"].append(hashlib.sha256(_line([(k, *s) for k in KINDS for s in base[k]]).encode()).hexdigest())
            out["spans"].append(_line(spans))
            out["n_hidden"].append(len(spans) - n)
        return out

    return map_texts(docs, fn, {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
                                "base_sha256": "string", "spans": "string", "n_hidden": "bigint"}, key, text_col)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[{kind}]") -> DataFrame:
    """The documents with every span of :func:`pii_spans` replaced by its mask; all columns
    and rows stay. A null text becomes the empty text."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: replace_spans(t, find_all(t)[1], mask))

    return docs.withColumn(text_col, masked(F.coalesce(F.col(text_col), F.lit(""))))


def replace_spans(t: str, spans, mask: str) -> str:
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [t[at:s], mask.format(kind=k.upper())]
        at = max(at, e)
    return "".join([*out, t[at:]])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document text."""
    return pii_spans(documents(spark, sf_dir))
