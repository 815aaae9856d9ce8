"""Text rewrites (F07, F09-F11) as built-in column expressions.

Whole texts are processed; no expression looks at a prefix only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white-space set of Go's strings.TrimSpace (unicode.IsSpace):
# TAB LF VT FF CR SPACE, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
GO_SPACE_CHARS = ("\t\n\x0b\x0c\r \u0085\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")
GO_SPACE_CLASS = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c) -> Column:
    """Go ``strings.TrimSpace``: strip Unicode white space at both ends (a character-set
    trim, no regular expression)."""
    return F.btrim(_c(c), F.lit(GO_SPACE_CHARS))


def split_clean(c, sep: str = ",", rtrim_chars: str | None = "/", lower: bool = True) -> Column:
    """split on a separator, trim each item, right-trim ``rtrim_chars``, lower-case.
    Empty items are kept, as ``strings.Split`` keeps them."""
    def clean(x):
        x = trim_space(x)
        if rtrim_chars:
            x = F.rtrim(x, F.lit(rtrim_chars))
        return F.lower(x) if lower else x
    return F.transform(F.split(_c(c), _java_quote(sep), -1), clean)


def quote_join(arr, sep: str = ", ", quote: str = "'") -> Column:
    """quote every element, doubling embedded quotes, and join."""
    q = F.lit(quote)
    return F.array_join(
        F.transform(_c(arr), lambda x: F.concat(q, F.replace(x, q, F.lit(quote * 2)), q)), sep)


def replace_first(c, pattern: str, replacement: str, ignore_case: bool = True) -> Column:
    """replace only the first match of ``pattern`` (Java regex, ``$n`` groups in
    ``replacement``). The leading reluctant group pins the rewrite to the first match."""
    flags = "(?s)" + ("(?i)" if ignore_case else "")
    shifted = _shift_groups(replacement)
    return F.regexp_replace(_c(c), f"{flags}^(.*?)(?:{_shift_back_references(pattern)})", f"$1{shifted}")


def replace_within(c, outer: str, inner: str, replacement: str, ignore_case: bool = False) -> Column:
    """inside every match of ``outer`` replace every literal ``inner`` by ``replacement``;
    text between matches is untouched. Split on the matches, rewrite the matches, zip back."""
    flags = "(?i)" if ignore_case else ""
    col = _c(c)
    gaps = F.split(col, flags + outer, -1)
    hits = F.regexp_extract_all(col, F.lit(flags + outer), 0)
    fixed = F.transform(hits, lambda m: F.replace(m, F.lit(inner), F.lit(replacement)))
    padded = F.concat(fixed, F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, padded, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def parse_list(text: str | None) -> list[str]:
    """P12 parameter parsing: comma-separated list, items trimmed, empties dropped."""
    if not text:
        return []
    return [t.strip() for t in text.split(",") if t.strip()]


def _java_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".$|()[]{}^?*+\\" else ch for ch in s)


def _shift_back_references(pattern: str) -> str:
    """Renumber ``\\n`` in a pattern by one; an escaped backslash is no reference."""
    return re.sub(r"\\(\\|[1-9][0-9]*|.)", lambda m: f"\\{int(m[1]) + 1}" if m[1].isdigit() else m[0], pattern)


def _shift_groups(rep: str) -> str:
    """Renumber ``$n`` references by one (group 1 is the text before the first match)."""
    out, i = [], 0
    while i < len(rep):
        if rep[i] == "$" and i + 1 < len(rep) and rep[i + 1].isdigit():
            j = i + 1
            while j < len(rep) and rep[j].isdigit():
                j += 1
            out.append("$" + str(int(rep[i + 1:j]) + 1))
            i = j
        else:
            out.append(rep[i])
            i += 1
    return "".join(out)
