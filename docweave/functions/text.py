"""Column -> Column text functions (all JVM-side, codegen-friendly).

Regular expressions are written so that the same pattern means the same
thing in Java regex and RE2 (the oracle engine): explicit whitespace
classes instead of ``\\s``, no look-around, no back-references.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (ASCII
# controls 9-13 and 28-31, space, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000), as one character class.
PY_SPACE_CLASS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# Default token counter: letter runs, 1-3 digit groups, and runs of other
# non-blank symbols (blank = ASCII whitespace).
TOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\t\n\x0B\f\r \p{L}\p{N}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()`` with Python's notion of whitespace."""
    return F.regexp_replace(_c(col), f"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$", "")


def clean_text(col) -> Column:
    """Page-text cleaner: strip, drop CR, tab -> blank, then collapse runs
    of newlines and of blanks to one (each replaced to a fixpoint, in
    that order). A newline-blank-newline sequence stays."""
    c = py_strip(col)
    c = F.regexp_replace(c, "\r", "")
    c = F.regexp_replace(c, "\t", " ")
    c = F.regexp_replace(c, "\n{2,}", "\n")
    return F.regexp_replace(c, " {2,}", " ")


def flatten_newlines(col, literal_newlines: bool = False) -> Column:
    """Corpus cleaner: newline -> blank, then two single passes of
    double-blank -> blank (a run of n blanks ends as ceil(ceil(n/2)/2)).

    ``literal_newlines`` also turns the two characters backslash-n into a
    blank; off by default, because the pinned pandas read that pattern as
    a regex for a newline and so never touched the literal."""
    c = F.replace(_c(col), F.lit("\n"), F.lit(" "))
    if literal_newlines:
        c = F.replace(c, F.lit("\\n"), F.lit(" "))
    c = F.replace(c, F.lit("  "), F.lit(" "))
    return F.replace(c, F.lit("  "), F.lit(" "))


def split_sentences(col) -> Column:
    """Split on the literal ``". "``; empty ends are kept (like str.split)."""
    return F.split(_c(col), r"\. ", -1)


def html_escape(col) -> Column:
    """``html.escape``: & < > " ' (ampersand first)."""
    c = F.replace(_c(col), F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    c = F.replace(c, F.lit('"'), F.lit("&quot;"))
    return F.replace(c, F.lit("'"), F.lit("&#x27;"))


# The references tried first, as (name, text,
# may-omit-semicolon). The names that may omit the semicolon are the
# legacy ones of HTML5 (e.g. "&amp" followed by text decodes too).
ENTITIES = [
    ("nbsp", "\u00a0", True), ("copy", "\u00a9", True), ("reg", "\u00ae", True),
    ("middot", "\u00b7", True), ("quot", '"', True), ("lt", "<", True), ("gt", ">", True),
    ("amp", "&", True), ("apos", "'", False), ("hellip", "\u2026", False),
    ("mdash", "\u2014", False), ("ndash", "\u2013", False), ("lsquo", "\u2018", False),
    ("rsquo", "\u2019", False), ("ldquo", "\u201c", False), ("rdquo", "\u201d", False),
    ("trade", "\u2122", False), ("#39", "'", False), ("#x27", "'", False),
]


def _entity_rules():
    """(prefix, text) checks in order: with ';' before the bare legacy form."""
    rules = []
    for name, ch, legacy in ENTITIES:
        rules.append((name + ";", ch))
        if legacy:
            rules.append((name, ch))
    return rules


def _named_references() -> Column:
    """Map of every HTML5 name that ends in ';' to its text, from the
    standard library's table."""
    import json
    from html.entities import html5
    return F.from_json(F.lit(json.dumps({n: t for n, t in html5.items() if n.endswith(";")})), "map<string,string>")


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


#: 0x80-0x9F as windows-1252 reads them.
_WINDOWS = [ord(bytes([k]).decode("cp1252", "ignore") or chr(k)) for k in range(128, 160)]


def _code_point(ref: Column) -> Column:
    """Text of a numeric reference (``#8217`` or ``#x2019``): 0x80-0x9F are
    read as windows-1252, and what is no character is U+FFFD."""
    hexa = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.regexp_extract(ref, r"([0-9a-fA-F]+);?$", 1)
    number = F.when(F.length(digits) > 10, F.lit(-1).cast("long")).when(hexa, F.conv(digits, 16, 10).cast("long")) \
        .otherwise(F.conv(F.when(hexa, "0").otherwise(digits), 10, 10).cast("long"))

    def sound(cp):
        bad = (cp <= 0) | (cp > 0x10FFFF) | cp.between(0xD800, 0xDFFF)
        return F.when(bad, F.lit(0xFFFD).cast("long")).when(
            cp.between(128, 159), F.get(F.lit(_WINDOWS), (cp - 128).cast("int")).cast("long")).otherwise(cp)
    return F.decode(F.unhex(F.lpad(F.hex(_bind(number, sound)), 8, "0")), "UTF-32")


def html_unescape(col) -> Column:
    """Decode character references in one left-to-right pass, JVM-side: the
    text is split at every '&' and the reference that a piece starts with is
    decoded, so decoded text is never decoded again ("&amp;amp;" -> "&amp;").
    Every HTML5 name with ';', the common legacy names without, and numeric
    references."""
    names = _named_references()

    def decode(p):
        out = None
        for prefix, ch in _entity_rules():
            cond = p.startswith(prefix)
            val = F.concat(F.lit(ch), F.substring(p, len(prefix) + 1, 1 << 30))
            out = F.when(cond, val) if out is None else out.when(cond, val)

        def other(ref):
            shown = F.when(ref == "", F.lit(None)).when(ref.startswith("#"), _code_point(ref)).otherwise(F.element_at(names, ref))
            return F.coalesce(F.concat(shown, F.substring(p, F.length(ref) + 1, F.lit(1 << 30))), F.concat(F.lit("&"), p))
        ref = F.regexp_extract(p, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};)", 1)
        return out.otherwise(_bind(ref, other))

    def run(v):
        pieces = F.split(v, "&", -1)
        rest = F.transform(F.slice(pieces, 2, 1 << 30), decode)
        # text without '&' (nearly all of it) skips the split
        return F.when(F.instr(v, "&") == 0, v).otherwise(
            F.concat(F.element_at(pieces, 1), F.array_join(rest, "")))

    return _bind(_c(col), run)


def html_unescape_full(col) -> Column:
    """Every HTML5 character reference, via an Arrow-batched pandas UDF
    on the standard library's ``html.unescape``."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def _unescape(s: pd.Series) -> pd.Series:
        import html
        return s.map(lambda v: None if v is None else html.unescape(v))

    return _unescape(_c(col))


def rfind(col, needle: str) -> Column:
    """0-based index of the last occurrence of ``needle``; -1 if absent."""
    c = _c(col)
    pos = F.locate(needle[::-1], F.reverse(c))
    return F.when(pos == 0, F.lit(-1)).otherwise(F.length(c) - pos - F.lit(len(needle)) + 1)


class TokenCounter:
    """Counts tokens of a string column.

    ``count(col)`` -> INT column; ``count_each(array_col)`` -> ARRAY<INT>.
    The default counts ``TOKEN_PATTERN`` matches, all JVM-side, so it can
    be used inside higher-order functions."""

    pattern = TOKEN_PATTERN

    def count(self, col) -> Column:
        return F.regexp_count(_c(col), F.lit(self.pattern))

    def count_each(self, arr) -> Column:
        return F.transform(_c(arr), lambda s: self.count(s))


class PandasTokenCounter(TokenCounter):
    """Wraps a Python ``encode(str) -> list`` (e.g. a tiktoken encoding)
    in Arrow-batched pandas UDFs. Slow path: use when exact parity with a
    given vocabulary matters more than speed."""

    def __init__(self, encode):
        self.encode = encode

    def count(self, col) -> Column:
        from pyspark.sql.functions import pandas_udf
        encode = self.encode

        @pandas_udf("int")
        def _count(s: pd.Series) -> pd.Series:
            return s.map(lambda v: None if v is None else len(encode(v)))

        return _count(_c(col))

    def count_each(self, arr) -> Column:
        from pyspark.sql.functions import pandas_udf
        encode = self.encode

        @pandas_udf("array<int>")
        def _count_each(s: pd.Series) -> pd.Series:
            return s.map(lambda v: None if v is None else [len(encode(x)) for x in v])

        return _count_each(_c(arr))


def tiktoken_counter(encoding: str = "cl100k_base") -> PandasTokenCounter | None:
    """A tiktoken-backed counter, or None when the vocabulary cannot be
    loaded (e.g. no network and no local cache)."""
    try:
        import tiktoken
        enc = tiktoken.get_encoding(encoding)
    except Exception:  # vocabulary not available offline
        return None
    return PandasTokenCounter(enc.encode)


DEFAULT_COUNTER = TokenCounter()


def token_count(col, counter: TokenCounter | None = None) -> Column:
    return (counter or DEFAULT_COUNTER).count(col)
