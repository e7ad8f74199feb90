"""URL column functions: link cleaning, same-site test, page keys and
blob names. Parsing follows RFC 3986 by regex (``parse_url`` drops the
port and rejects URLs with blanks; the same-site test needs both)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# Fixed patterns.
SCHEME_RE = r"^([^:/?#]+)://"
NETLOC_RE = r"^[^:/?#]+://([^/?#]*)"
PATH_RE = r"^[^:/?#]+://[^/?#]*([^?#]*)"
ABSOLUTE_RE = r"^http[s]*://."          # 'http', any number of 's', '://', one char
SKIP_PREFIXES = ("#", "mailto:", "tel:")
# splitext: the last dot of the last path segment, if a non-dot character
# precedes it in that segment.
EXT_RE = r"^((?:.*/)?\.*[^/.][^/]*)\.[^/.]*$"
PARAMS_RE = r";[^/]*$"


def scheme(url) -> Column:
    return F.regexp_extract(_c(url), SCHEME_RE, 1)


def netloc(url) -> Column:
    """Authority part (host and port, case kept); '' when no scheme."""
    return F.regexp_extract(_c(url), NETLOC_RE, 1)


def url_path(url) -> Column:
    return F.regexp_extract(_c(url), PATH_RE, 1)


def strip_one_trailing_slash(c: Column) -> Column:
    return F.when(c.endswith("/"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def starts_with_any(c: Column, prefixes=SKIP_PREFIXES) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def clean_link(href, base_scheme, base_netloc, limit_domain: bool) -> Column:
    """Normalise one href against the site root.

    1. '#...', 'mailto:...', 'tel:...' are returned unchanged.
    2. absolute http(s) links are kept; with ``limit_domain`` only when
       their authority equals ``base_netloc`` (else '').
    3. anything else is a path from the site root: one leading '/' is
       dropped and ``scheme://netloc/`` put in front (so '../x', '?q',
       '//cdn/x' all land under the root).
    4. one trailing '/' is dropped. Query and fragment are kept."""
    h = _c(href)
    bs, bn = _c(base_scheme), _c(base_netloc)
    absolute = h.rlike(ABSOLUTE_RE)
    if limit_domain:
        kept_abs = F.when(netloc(h) == bn, h).otherwise(F.lit(""))
    else:
        kept_abs = h
    rel = F.when(h.startswith("/"), h.substr(F.lit(2), F.length(h))).otherwise(h)
    relative = F.concat(bs, F.lit("://"), bn, F.lit("/"), rel)
    cleaned = F.when(absolute, kept_abs).otherwise(relative)
    cleaned = strip_one_trailing_slash(cleaned)
    return F.when(starts_with_any(h), h).otherwise(cleaned)


def clean_link_legacy(href, base_netloc) -> Column:
    """Older cleaner: always https, same-site absolute links only; '#' and
    'mailto:' dropped (NULL) but 'tel:' treated as a path; '' -> site root."""
    h = _c(href)
    bn = _c(base_netloc)
    absolute = h.rlike(ABSOLUTE_RE)
    rel = F.when(h.startswith("/"), h.substr(F.lit(2), F.length(h))).otherwise(h)
    out = (F.when(absolute, F.when(netloc(h) == bn, h))
           .when(h.startswith("/"), F.concat(F.lit("https://"), bn, F.lit("/"), rel))
           .when(h.startswith("#") | h.startswith("mailto:"), F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("https://"), bn, F.lit("/"), rel)))
    return strip_one_trailing_slash(out)


def page_key(url) -> Column:
    """Output file name of a page: drop one trailing '/', take the path,
    drop its extension, drop one leading '/', '/' -> '_'; no path -> 'home'.
    A path of exactly '/' gives '' (the page is not saved)."""
    u = strip_one_trailing_slash(_c(url))
    # the path without ";params" of its last segment (as urlparse splits it)
    path = F.regexp_replace(url_path(u), PARAMS_RE, "")
    stem = F.regexp_replace(path, EXT_RE, "$1")
    stem = F.when(stem.startswith("/"), stem.substr(F.lit(2), F.length(stem))).otherwise(stem)
    return F.when(path == "", F.lit("home")).otherwise(F.replace(stem, F.lit("/"), F.lit("_")))


def page_key_legacy(url) -> Column:
    """Older key: URL without its first 8 characters, '/' -> '_', '.txt'."""
    return F.concat(F.replace(F.substring(_c(url), 9, 1 << 30), F.lit("/"), F.lit("_")), F.lit(".txt"))


def basename(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def blob_name(filename, page=None) -> Column:
    """``name-<page>.pdf`` for PDFs (extension compared lower-cased),
    else the base name."""
    base = basename(filename)
    stem = F.regexp_replace(base, EXT_RE, "$1")
    ext = F.substring(base, F.length(stem) + 1, 1 << 30)
    is_pdf = F.lower(ext) == ".pdf"
    pg = F.lit(0) if page is None else _c(page)
    return F.when(is_pdf, F.concat(stem, F.lit("-"), pg.cast("string"), F.lit(".pdf"))).otherwise(base)


def sanitize_id(col) -> Column:
    """Keys may hold only ASCII letters, digits, '_' and '-'."""
    return F.regexp_replace(_c(col), r"[^0-9a-zA-Z_-]", "_")
