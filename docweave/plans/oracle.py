"""DuckDB SQL for each registered query: the independent check of the Spark
plans. Nothing of the engine is imported: patterns, tag lists and constants
are stated here again, in the words of RE2. DuckDB writes group references as
\\1 and needs the 'g' flag to replace all matches."""

from __future__ import annotations

# Python's white space, the token and word patterns, the size of
# an embedding, the tags of the audit and the line export, the dropped tags.
PY_SPACE_CLASS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
TOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\t\n\x0B\f\r \p{L}\p{N}]+"
BLANK = r"[\t\n\x0B\f\r ]"
EMBED_TOKEN_PATTERN, EMBED_DIM = r"\p{L}+|\p{N}+", 64
PRINT_TAGS = ("h1 h2 h3 h4 h5 h6 p li a span em strong u sub small address").split()
CONTAINER_TAGS = ("main label div header section noscript ul iframe body nav input article br img hr aside content table "
                  "tr th time sup ol tbody td").split()
RAW_TEXT_TAGS = ["script", "style"]
DROPPED_TAGS = ["script", "style", "link", "meta", "symbol", "svg", "form", "button"]


def tok(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN_PATTERN}'))"


def py_strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$', '', 'g')"


def flatten(x: str) -> str:
    return f"replace(replace(replace({x}, chr(10), ' '), '  ', ' '), '  ', ' ')"


def clean(x: str) -> str:
    c = f"regexp_replace({x}, '^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$', '', 'g')"
    c = f"replace({c}, chr(13), '')"
    c = f"replace({c}, chr(9), ' ')"
    c = f"regexp_replace({c}, '\\n{{2,}}', chr(10), 'g')"
    return f"regexp_replace({c}, ' {{2,}}', ' ', 'g')"


def pack(x: str, limit: int = 500) -> str:
    """Fold of sentences into chunks: (done, cur, n); nothing is dropped."""
    flush = f"(acc.n + x.c > {limit})"
    units = f"regexp_extract_all(x.s, '{BLANK}*(?:{TOKEN_PATTERN})|{BLANK}+$')"
    cut = (f"list_transform([{units}], lambda u: list_transform(range(0, CAST(ceil(len(u) / {limit - 1}.0) AS BIGINT)), "
           f"lambda i: array_to_string(u[i * {limit - 1} + 1:(i + 1) * {limit - 1}], '')))[1]")
    return f"""list_reduce(
      list_transform(string_split_regex({x}, '\\. '), lambda s: struct_pack(s := s, c := {tok("' ' || s")})),
      lambda acc, x: struct_pack(
        done := list_concat(
          CASE WHEN {flush} AND len(acc.cur) > 0 THEN list_append(acc.done, array_to_string(acc.cur, '. ') || '.') ELSE acc.done END,
          CASE WHEN x.c > {limit} THEN {cut} ELSE []::VARCHAR[] END),
        cur := CASE WHEN x.c > {limit} THEN []::VARCHAR[]
                    ELSE list_append(CASE WHEN {flush} THEN []::VARCHAR[] ELSE acc.cur END, x.s) END,
        n := CASE WHEN x.c > {limit} THEN 0 ELSE (CASE WHEN {flush} THEN 0 ELSE acc.n END) + x.c + 1 END),
      struct_pack(done := []::VARCHAR[], cur := []::VARCHAR[], n := 0))"""


def pack_parts(r: str) -> str:
    return (f"CASE WHEN len({r}.cur) > 0 THEN list_append({r}.done, array_to_string({r}.cur, '. ') || '.') "
            f"ELSE {r}.done END")


CORPUS = f"""corpus AS (
  SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS fname,
         source || '/' || CAST(doc_id AS VARCHAR) || '.txt' || '. ' || {flatten('text')} AS text
  FROM documents)"""


def chunks_cte(limit: int = 500) -> str:
    return f"""{CORPUS},
folded AS (
  SELECT doc_id, text, CASE WHEN {tok('text')} > {limit} THEN {pack('text', limit)} END AS r
  FROM corpus WHERE text IS NOT NULL),
chunked AS (
  SELECT doc_id, CASE WHEN r IS NULL THEN [text] ELSE {pack_parts('r')} END AS parts FROM folded),
chunks AS (
  SELECT doc_id, unnest(range(len(parts))) AS chunk_no, unnest(parts) AS text FROM chunked)"""


def embed(x: str, dim: int = EMBED_DIM) -> str:
    buckets = (f"list_transform(regexp_extract_all(lower({x}), '{EMBED_TOKEN_PATTERN}'), "
               f"lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % {dim})::INTEGER)")
    return (f"list_transform([{buckets}], lambda bs: list_transform(range({dim}), "
            f"lambda i: len(list_filter(bs, lambda b: b = i))::DOUBLE))[1]")


def dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), "
            f"lambda s, v: s + v, 0.0::DOUBLE)")


def cosine(a: str, b: str) -> str:
    den = f"sqrt({dot(a, a)} * {dot(b, b)})"
    return f"(CASE WHEN {den} > 0 THEN least(abs(1.0 - {dot(a, b)} / {den}), 2.0) END)"


ORACLE: dict[str, str] = {}

ORACLE["token_counts"] = f"""
SELECT doc_id, length(text)::BIGINT AS n_chars, {tok('text')}::BIGINT AS n_tokens FROM documents"""

ORACLE["clean_text"] = f"""SELECT doc_id, {clean('text')} AS text FROM documents"""

ORACLE["corpus"] = f"""WITH {CORPUS}
SELECT doc_id, fname, text, {tok('text')}::BIGINT AS n_tokens FROM corpus"""

ORACLE["chunks"] = f"""WITH {chunks_cte()}
SELECT doc_id, chunk_no::BIGINT AS chunk_no, text, {tok('text')}::BIGINT AS n_tokens FROM chunks"""

ORACLE["sentence_pack"] = f"""WITH {chunks_cte(200)}
SELECT doc_id, chunk_no::BIGINT AS chunk_no, text, {tok('text')}::BIGINT AS n_tokens FROM chunks"""

ORACLE["token_histogram"] = f"""WITH {CORPUS},
t AS (SELECT {tok('text')}::BIGINT AS n FROM corpus),
s AS (SELECT min(n) AS lo, max(n) AS hi FROM t),
b AS (SELECT CASE WHEN s.hi = s.lo THEN 6 ELSE least(floor((t.n - s.lo) * 10 / (s.hi - s.lo)) + 1, 10) END::BIGINT AS bin,
             count(*) AS c
      FROM t, s GROUP BY ALL)
SELECT g.bin::BIGINT AS bin, s.lo, s.hi, coalesce(b.c, 0)::BIGINT AS count
FROM s, (SELECT unnest(range(1, 11)) AS bin) g LEFT JOIN b ON b.bin = g.bin"""

ORACLE["hash_embed"] = f"""WITH {chunks_cte()},
e AS (SELECT doc_id, chunk_no, {embed('text')} AS v FROM chunks)
SELECT doc_id, chunk_no::BIGINT AS chunk_no, bucket::BIGINT AS bucket, count::BIGINT AS count
FROM (SELECT doc_id, chunk_no, unnest(range(len(v))) AS bucket, unnest(v) AS count FROM e)
WHERE count > 0"""

CONTEXT_CTE = f"""{chunks_cte()},
c AS (SELECT (doc_id, chunk_no) AS chunk_id, text, {tok('text')} AS n_tokens, {embed('text')} AS v FROM chunks),
q AS (SELECT item_id AS question_id, {embed('text')} AS qv FROM benchmark),
scored AS (SELECT q.question_id, c.chunk_id, c.text, c.n_tokens, {cosine('q.qv', 'c.v')} AS distance FROM q, c),
run AS (SELECT *, sum(n_tokens + 4) OVER (PARTITION BY question_id ORDER BY distance ASC NULLS LAST, chunk_id
                                         ROWS UNBOUNDED PRECEDING) AS used,
               row_number() OVER (PARTITION BY question_id ORDER BY distance ASC NULLS LAST, chunk_id) AS rn
        FROM scored WHERE distance IS NOT NULL)"""

ORACLE["context"] = f"""WITH {CONTEXT_CTE},
k AS (SELECT question_id, string_agg(text, chr(10) || chr(10) || '###' || chr(10) || chr(10) ORDER BY rn) AS context,
             count(*)::BIGINT AS n_chunks, max(used)::BIGINT AS used_tokens
      FROM run WHERE used <= 1800 GROUP BY question_id)
SELECT q.question_id, coalesce(k.context, '') AS context, coalesce(k.n_chunks, 0)::BIGINT AS n_chunks,
       coalesce(k.used_tokens, 0)::BIGINT AS used_tokens
FROM q LEFT JOIN k ON k.question_id = q.question_id"""

ORACLE["nearest"] = f"""WITH q AS (SELECT item_id AS question_id, {embed('text')} AS qv FROM benchmark),
s AS (SELECT q.question_id, e.vec_id, e.label, {cosine('q.qv', 'e.embedding')} AS distance FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance ASC NULLS LAST, vec_id) AS rank FROM s WHERE distance IS NOT NULL)
SELECT question_id, rank::BIGINT AS rank, vec_id, label::BIGINT AS label, round(distance, 6) AS distance
FROM r WHERE rank <= 5"""


# ------------------------------------------------------------------ web
class U:
    """Patterns of URLs."""

    SCHEME_RE = r"^([^:/?#]+)://"
    NETLOC_RE = r"^[^:/?#]+://([^/?#]*)"
    PATH_RE = r"^[^:/?#]+://[^/?#]*([^?#]*)"
    ABSOLUTE_RE = r"^http[s]*://."
    EXT_RE = r"^((?:.*/)?\.*[^/.][^/]*)\.[^/.]*$"
    PARAMS_RE = r";[^/]*$"


class H:
    """Patterns of markup: well-formed tags without '>' in attributes."""

    WS = r"[ \t\n\r\f]"
    TAG_RE = r"(?s)</?[a-zA-Z][^>]*>|<![^>]*>"
    ANCHOR_RE = r"(?is)<a(?:" + WS + r"[^>]*)?>.*?</a" + WS + r"*>"
    ANCHOR_OPEN_RE = r"(?is)<a(?:" + WS + r"[^>]*)?>"
    HREF_PRE_RE = r"(?is)^(<a[^>]*?" + WS + r"href" + WS + r"*=" + WS + r"*)"
    HREF_VALUE_RE = r"(?is)^<a[^>]*?" + WS + r"href" + WS + r"*=" + WS + r"""*("[^"]*"|'[^']*'|[^ \t\n\r\f>]+)"""
    HAS_HREF_RE = r"(?is)^<a[^>]*?" + WS + r"href" + WS + r"*="
    TITLE_RE = r"(?is)<title[^>]*>(.*?)</title" + WS + r"*>"
    BODY_RE = r"(?is)<body(?:" + WS + r"[^>]*)?>(.*?)(?:</body" + WS + r"*>|\z)"
    CLASS_ATTR_RE = r"(?i)" + WS + r"+class" + WS + r"*=" + WS + r"""*(?:"[^"]*"|'[^']*'|[^ \t\n\r\f>]+)"""
    RAW_TEXT_TAGS = RAW_TEXT_TAGS
    DROPPED_TAGS = DROPPED_TAGS


def removal_re(tags) -> str:
    """Raw-text elements, comments, then the other elements, in one pass."""
    def element(t):
        if t in ("link", "meta"):
            return rf"<{t}(?:{H.WS}[^>]*)?/?>"
        return rf"<{t}(?:{H.WS}[^>]*)?/>|<{t}(?:{H.WS}[^>]*)?>.*?</{t}{H.WS}*>"
    raw = [element(t) for t in tags if t in RAW_TEXT_TAGS]
    return "(?is)" + "|".join([*raw, "<!--.*?-->", *(element(t) for t in tags if t not in RAW_TEXT_TAGS)])


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip1(x: str) -> str:
    return f"(CASE WHEN ends_with({x}, '/') THEN left({x}, length({x}) - 1) ELSE {x} END)"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, {lit(U.NETLOC_RE)}, 1)"


def scheme(x: str) -> str:
    return f"regexp_extract({x}, {lit(U.SCHEME_RE)}, 1)"


def skip_prefix(x: str) -> str:
    return f"(starts_with({x}, '#') OR starts_with({x}, 'mailto:') OR starts_with({x}, 'tel:'))"


def clean_link(h: str, bs: str, bn: str, limit: bool) -> str:
    kept = f"(CASE WHEN {netloc(h)} = {bn} THEN {h} ELSE '' END)" if limit else h
    rel = f"(CASE WHEN starts_with({h}, '/') THEN substr({h}, 2) ELSE {h} END)"
    cleaned = (f"(CASE WHEN regexp_matches({h}, {lit(U.ABSOLUTE_RE)}) THEN {kept} "
               f"ELSE {bs} || '://' || {bn} || '/' || {rel} END)")
    return f"(CASE WHEN {skip_prefix(h)} THEN {h} ELSE {strip1(cleaned)} END)"


def clean_link_legacy(h: str, bn: str) -> str:
    rel = f"substr({h}, 2)"
    out = (f"(CASE WHEN regexp_matches({h}, {lit(U.ABSOLUTE_RE)}) THEN (CASE WHEN {netloc(h)} = {bn} THEN {h} END) "
           f"WHEN starts_with({h}, '/') THEN 'https://' || {bn} || '/' || {rel} "
           f"WHEN starts_with({h}, '#') OR starts_with({h}, 'mailto:') THEN NULL "
           f"ELSE 'https://' || {bn} || '/' || {h} END)")
    return strip1(out)


def page_key(url: str) -> str:
    u = strip1(url)
    path = f"regexp_replace(regexp_extract({u}, {lit(U.PATH_RE)}, 1), {lit(U.PARAMS_RE)}, '')"
    stem = f"regexp_replace({path}, {lit(U.EXT_RE)}, '\\1')"
    stem2 = f"(CASE WHEN starts_with({stem}, '/') THEN substr({stem}, 2) ELSE {stem} END)"
    return f"(CASE WHEN {path} = '' THEN 'home' ELSE replace({stem2}, '/', '_') END)"


#: References that the pages of the fixtures hold, and some more.
REFERENCES = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'", "nbsp;": "\u00a0", "copy;": "\u00a9", "reg;": "\u00ae",
              "middot;": "\u00b7", "hellip;": "\u2026", "mdash;": "\u2014", "ndash;": "\u2013", "lsquo;": "\u2018", "rsquo;": "\u2019",
              "ldquo;": "\u201c", "rdquo;": "\u201d", "trade;": "\u2122", "eacute;": "\u00e9", "rarr;": "\u2192", "amp": "&", "lt": "<",
              "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "middot": "\u00b7"}


def unescape(x: str) -> str:
    cases = " ".join(f"WHEN starts_with(p, {lit(name)}) THEN {lit(ch)} || substr(p, {len(name) + 1})" for name, ch in REFERENCES.items())
    number = "WHEN regexp_matches(p, '^#[0-9]+;') THEN chr(regexp_extract(p, '^#([0-9]+);', 1)::INTEGER) || regexp_replace(p, '^#[0-9]+;', '')"
    return (f"list_transform([string_split({x}, '&')], lambda ps: ps[1] || array_to_string("
            f"list_transform(ps[2:], lambda p: CASE {cases} {number} ELSE '&' || p END), ''))[1]")


def remove_elements(x: str, tags=H.DROPPED_TAGS) -> str:
    return f"regexp_replace({x}, {lit(removal_re(tags))}, '', 'g')"


def body(x: str) -> str:
    return f"regexp_extract({x}, {lit(H.BODY_RE)}, 1)"


def title(x: str) -> str:
    t = unescape(f"regexp_extract({x}, {lit(H.TITLE_RE)}, 1)")
    return f"(CASE WHEN {t} <> '' THEN {t} END)"


def tag_text(x: str) -> str:
    return unescape(f"regexp_replace({x}, {lit(H.TAG_RE)}, '', 'g')")


def href_value(tag: str) -> str:
    raw = f"regexp_extract({tag}, {lit(H.HREF_VALUE_RE)}, 1)"
    unq = (f"(CASE WHEN starts_with({raw}, '\"') OR starts_with({raw}, '''') "
           f"THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END)")
    return unescape(unq)


def hrefs(x: str) -> str:
    return (f"list_transform(list_filter(regexp_extract_all({x}, {lit(H.ANCHOR_OPEN_RE)}), "
            f"lambda t: regexp_matches(t, {lit(H.HAS_HREF_RE)})), lambda t: {href_value('t')})")


def interleave(x: str, pattern: str, piece_fn, match_fn) -> str:
    """Mirror of the split + zip rewrite: text between matches through
    ``piece_fn``, each match through ``match_fn`` (SQL builders)."""
    pieces = f"string_split_regex({x}, {lit(pattern)})"
    matches = f"regexp_extract_all({x}, {lit(pattern)})"
    return (f"list_transform([struct_pack(p := {pieces}, m := {matches})], lambda z: "
            f"CASE WHEN len(z.m) = 0 THEN {piece_fn(x)} ELSE "
            f"array_to_string(list_transform(range(1, len(z.m) + 1), lambda i: "
            f"{piece_fn('z.p[i]')} || {match_fn('z.m[i]')}), '') || {piece_fn('z.p[len(z.p)]')} END)[1]")


def inline_links(b: str, bs: str, bn: str) -> str:
    def render(a):
        href = href_value(a)
        inner = f"regexp_extract({a}, {lit('(?is)^<a[^>]*>(.*)</a' + H.WS + '*>$')}, 1)"
        shown = f"(CASE WHEN {href} = '' THEN {href} ELSE {clean_link(href, bs, bn, False)} END)"
        return f"(CASE WHEN {href} = '#' THEN '' ELSE {tag_text(inner)} || ' ' || {shown} || ' ' END)"
    return interleave(b, H.ANCHOR_RE, tag_text, render)


def rewrite_hrefs(b: str, bs: str, bn: str) -> str:
    def fix(tag):
        raw = f"regexp_extract({tag}, {lit(H.HREF_VALUE_RE)}, 1)"
        h = href_value(tag)
        new = clean_link(h, bs, bn, False)
        skip = f"({h} = '' OR starts_with({h}, 'tel:') OR starts_with({h}, 'mailto:') OR {new} = {h})"
        pre = f"regexp_extract({tag}, {lit(H.HREF_PRE_RE)}, 1)"
        post = f"substr({tag}, length({pre}) + length({raw}) + 1)"
        return (f"(CASE WHEN {skip} THEN {tag} ELSE {pre} || '\"' || replace({new}, '\"', '&quot;') || '\"' "
                f"|| {post} END)")
    return interleave(b, H.ANCHOR_OPEN_RE, lambda p: p, fix)


SITE = f"""site AS (
  SELECT page_id, url, html, {scheme('url')} AS bs, {netloc('url')} AS bn, {page_key('url')} AS page_key
  FROM pages)"""

ORACLE["page_key"] = f"""WITH {SITE}
SELECT page_id, url, bn AS netloc, page_key FROM site"""

LINKS_CTE = f"""{SITE},
h AS (SELECT page_id, url, bs, bn, unnest({hrefs(body(remove_elements('html')))}) AS h FROM site),
f AS (SELECT page_id, url, bs, bn, CASE WHEN h = '' THEN h ELSE {clean_link('h', 'bs', 'bn', False)} END AS h1 FROM h),
links AS (SELECT DISTINCT page_id, url, link FROM (
  SELECT page_id, url, {clean_link('h1', 'bs', 'bn', True)} AS link FROM f
  WHERE h1 <> '' AND NOT {skip_prefix('h1')}) WHERE link <> '')"""

ORACLE["links"] = f"""WITH {LINKS_CTE}
SELECT page_id, url, link FROM links"""

ORACLE["links_legacy"] = f"""WITH {SITE},
h AS (SELECT DISTINCT page_id, url, bn, unnest({hrefs(remove_elements('html', H.RAW_TEXT_TAGS))}) AS h FROM site)
SELECT DISTINCT page_id, url, link FROM (SELECT page_id, url, {clean_link_legacy('h', 'bn')} AS link FROM h)
WHERE link IS NOT NULL"""

ORACLE["page_dedup"] = f"""WITH {SITE}
SELECT bn AS netloc, page_key, count(*)::BIGINT AS n_versions, max(page_id) AS page_id,
       arg_max(url, page_id) AS url
FROM site WHERE page_key <> '' GROUP BY bn, page_key"""

ORACLE["simplify_html"] = f"""WITH {SITE},
b AS (SELECT page_id, url, bs, bn, page_key, {title('html')} AS title,
             regexp_replace({body(remove_elements('html'))}, {lit(H.CLASS_ATTR_RE)}, '', 'g') AS b FROM site)
SELECT page_id, url, bn AS netloc, page_key, title, {rewrite_hrefs('b', 'bs', 'bn')} AS html FROM b"""

ORACLE["page_text"] = f"""WITH {SITE},
b AS (SELECT page_id, url, bs, bn, page_key, {title('html')} AS title, {body(remove_elements('html'))} AS b FROM site),
t AS (SELECT page_id, url, bn, page_key, title, {clean(inline_links('b', 'bs', 'bn'))} AS txt FROM b)
SELECT page_id, url, bn AS netloc, page_key,
       CASE WHEN title IS NULL THEN txt ELSE title || chr(10) || chr(10) || txt END AS text,
       page_key <> '' AS saved
FROM t"""

ORACLE["page_text_plain"] = f"""SELECT page_id, url, replace(substr(url, 9), '/', '_') || '.txt' AS page_key,
  replace(replace(replace(replace({tag_text(body(remove_elements('html', H.RAW_TEXT_TAGS)))},
    chr(10), ' '), '\\n', ' '), '  ', ' '), '  ', ' ') AS text
FROM pages"""


def block(tag: str) -> str:
    return lit(r"(?is)(<" + tag + r"(?:" + H.WS + r"[^>]*)?>.*?</" + tag + H.WS + r"*>)")


ORACLE["page_parts"] = f"""WITH b AS (
  SELECT page_id, url,
         nullif(regexp_extract(html, {block('header')}, 1), '') AS header,
         nullif(regexp_extract(html, {lit('(?is)(<body(?:' + H.WS + '[^>]*)?>.*?(?:</body' + H.WS + '*>|\\z))')}, 1), '') AS body,
         nullif(regexp_extract(html, {block('footer')}, 1), '') AS footer
  FROM pages)
SELECT page_id, url, header, body, footer, length(header)::BIGINT AS header_len,
       length(body)::BIGINT AS body_len, length(footer)::BIGINT AS footer_len FROM b"""

KNOWN_TAGS = "[" + ", ".join(lit(t) for t in PRINT_TAGS + CONTAINER_TAGS) + "]"

ORACLE["tag_audit"] = f"""WITH b AS (
  SELECT page_id, url, regexp_replace({body(remove_elements('html'))}, {lit(H.CLASS_ATTR_RE)}, '', 'g') AS h FROM pages),
n AS (SELECT page_id, url, list_sort(list_distinct(list_transform(
        regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)))) AS names FROM b),
u AS (SELECT page_id, url, names, list_sort(list_filter(names, lambda x: NOT list_contains({KNOWN_TAGS}, x))) AS unh FROM n)
SELECT page_id, url, array_to_string(names, ',') AS tags, array_to_string(unh, ',') AS unhandled,
       len(unh) = 0 AS convertible FROM u"""

ORACLE["frontier"] = f"""WITH RECURSIVE {LINKS_CTE},
edges AS (SELECT DISTINCT {strip1('url')} AS src, link AS dst FROM links),
walk(url, depth) AS (
  SELECT DISTINCT {strip1('url')}, 1 FROM pages
  UNION
  SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < 2)
SELECT url, min(depth)::BIGINT AS depth FROM walk GROUP BY url"""


# ------------------------------------------------------------- sections
WB_CLASS = r"[,;: ()\[\]{}\t\n]"
WB_NOT = r"[^,;: ()\[\]{}\t\n]"


def _end(t: str, n: str, nxt: str) -> str:
    fw = f"substr({t}, {nxt} + 1001, 100)"
    k = f"length(regexp_extract({fw}, '^[^.!?]*'))"
    last_wb = f"(length({fw}) - length(regexp_extract({fw}, '{WB_NOT}*$')) - 1)"
    return f"""(CASE WHEN {nxt} + 1000 >= {n} THEN {n}
      WHEN regexp_matches({fw}, '[.!?]') THEN {nxt} + 1000 + {k} + 1
      WHEN {nxt} + 1100 >= {n} THEN {n}
      WHEN regexp_matches(substr({t}, {nxt} + 1101, 1), '[.!?]') THEN {nxt} + 1101
      WHEN regexp_matches({fw}, '{WB_CLASS}') THEN {nxt} + 1000 + {last_wb} + 1
      ELSE {nxt} + 1101 END)"""


def _start(t: str, nxt: str, e: str) -> str:
    lo = f"greatest(0, {e} - 1200)"
    bw = f"substr({t}, {lo} + 2, {nxt} - {lo})"
    last_se = f"(length({bw}) - length(regexp_extract({bw}, '[^.!?]*$')) - 1)"
    first_wb = f"length(regexp_extract({bw}, '^{WB_NOT}*'))"
    plus = f"(CASE WHEN {lo} > 0 THEN {lo} + 1 ELSE {lo} END)"
    return f"""(CASE WHEN {nxt} <= 0 THEN 0
      WHEN {nxt} > {lo} AND regexp_matches({bw}, '[.!?]') THEN {lo} + 2 + {last_se}
      WHEN regexp_matches(substr({t}, {lo} + 1, 1), '[.!?]') THEN {plus}
      WHEN {nxt} > {lo} AND regexp_matches({bw}, '{WB_CLASS}') THEN {lo} + 2 + {first_wb}
      ELSE {plus} END)"""


def _carry(t: str, a: str, e: str) -> str:
    sec = f"substr({t}, {a} + 1, {e} - {a})"
    lt = f"(CASE WHEN strpos({sec}, '<table') > 0 THEN length(regexp_extract({sec}, '(?s)^(.*)<table', 1)) ELSE -1 END)"
    ltc = f"(CASE WHEN strpos({sec}, '</table') > 0 THEN length(regexp_extract({sec}, '(?s)^(.*)</table', 1)) ELSE -1 END)"
    return f"(CASE WHEN {lt} > 200 AND {lt} > {ltc} THEN least({e} - 100, {a} + {lt}) ELSE {e} - 100 END)"


def sections_cte(docs: str) -> str:
    """``docs(sourcefile, t, n)`` -> spans(sourcefile, section_no, a, e)."""
    return f"""steps(sourcefile, i, nxt, a, e, emit, pa, pe) AS (
  SELECT sourcefile, 0, 0, x.a, x.e, true, x.a, x.e FROM {docs} d,
    LATERAL (SELECT {_end('d.t', 'd.n', '0')} AS e) y,
    LATERAL (SELECT 0 AS a, y.e AS e) x
  WHERE 100 < d.n
  UNION ALL
  SELECT s.sourcefile, s.i + 1, p.nxt, q.a, r.e, NOT (q.a = s.pa AND r.e = s.pe),
         CASE WHEN s.emit THEN s.a ELSE s.pa END, CASE WHEN s.emit THEN s.e ELSE s.pe END
  FROM steps s JOIN {docs} d ON d.sourcefile = s.sourcefile,
    LATERAL (SELECT CASE WHEN s.emit THEN {_carry('d.t', 's.a', 's.e')} ELSE s.e - 100 END AS nxt) p,
    LATERAL (SELECT {_end('d.t', 'd.n', 'p.nxt')} AS e) r,
    LATERAL (SELECT {_start('d.t', 'p.nxt', 'r.e')} AS a) q
  WHERE p.nxt + 100 < d.n),
spans AS (
  SELECT sourcefile, (row_number() OVER (PARTITION BY sourcefile ORDER BY i) - 1) AS section_no, a, e
  FROM steps WHERE emit
  UNION ALL SELECT sourcefile, 0, 0, n FROM {docs} WHERE n BETWEEN 1 AND 100)"""


def blob_name(f: str, page: str) -> str:
    base = f"regexp_extract({f}, '([^/]*)$', 1)"
    stem = f"regexp_replace({base}, {lit(U.EXT_RE)}, '\\1')"
    ext = f"substr({base}, length({stem}) + 1)"
    return f"(CASE WHEN lower({ext}) = '.pdf' THEN {stem} || '-' || CAST({page} AS VARCHAR) || '.pdf' ELSE {base} END)"


def sanitize(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9a-zA-Z_-]', '_', 'g')"


DOC_SECTIONS = f"""docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) || '.txt' AS sourcefile, d.text AS t, length(d.text) AS n,
         'quality=' || CAST(l.quality AS VARCHAR) AS category, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL),
{sections_cte('docs')},
sections AS (
  SELECT {sanitize("s.sourcefile || '-' || CAST(s.section_no AS VARCHAR)")} AS id,
         substr(d.t, s.a + 1, s.e - s.a) AS content, d.category,
         {blob_name('s.sourcefile', '0')} AS sourcepage, s.sourcefile,
         s.section_no, s.a AS start, s.e AS "end", 0 AS page_num, d.toxic
  FROM spans s JOIN docs d ON d.sourcefile = s.sourcefile)"""

ORACLE["sections"] = f"""WITH RECURSIVE {DOC_SECTIONS}
SELECT id, content, category, sourcepage, sourcefile, section_no::BIGINT AS section_no,
       start::BIGINT AS start, "end"::BIGINT AS "end", page_num::BIGINT AS page_num FROM sections"""

CONV_PAGES = """pm AS (
  SELECT CAST(conv_id AS VARCHAR) || '.pdf' AS sourcefile, turn::INTEGER AS page_num, text,
         coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_off
  FROM conversations)"""

ORACLE["page_map"] = f"""WITH {CONV_PAGES}
SELECT sourcefile, page_num::BIGINT AS page_num, page_off::BIGINT AS page_off, text FROM pm"""

ORACLE["section_pages"] = f"""WITH RECURSIVE {CONV_PAGES},
docs AS (SELECT sourcefile, string_agg(coalesce(text, ''), '' ORDER BY page_num) AS t,
                length(string_agg(coalesce(text, ''), '' ORDER BY page_num)) AS n FROM pm GROUP BY sourcefile),
{sections_cte('docs')},
pg AS (SELECT s.sourcefile, s.section_no, s.a, s.e,
              (SELECT max(page_num) FROM pm WHERE pm.sourcefile = s.sourcefile AND pm.page_off <= s.a) AS page_num
       FROM spans s)
SELECT {sanitize("pg.sourcefile || '-' || CAST(pg.section_no AS VARCHAR)")} AS id,
       substr(d.t, pg.a + 1, pg.e - pg.a) AS content, {blob_name('pg.sourcefile', 'pg.page_num')} AS sourcepage,
       pg.sourcefile, pg.section_no::BIGINT AS section_no, pg.a::BIGINT AS start, pg.e::BIGINT AS "end",
       pg.page_num::BIGINT AS page_num
FROM pg JOIN docs d ON d.sourcefile = pg.sourcefile"""

ALL_PAGES = f"""{CONV_PAGES},
allpages AS (
  SELECT sourcefile, page_num, text FROM pm
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR) || '.txt', 0, text FROM documents)"""

ORACLE["blob_names"] = f"""WITH {ALL_PAGES}
SELECT sourcefile, page_num::BIGINT AS page_num, {blob_name('sourcefile', 'page_num')} AS blob_name FROM allpages"""

def is_pdf(f: str) -> str:
    base = f"regexp_extract({f}, '([^/]*)$', 1)"
    stem = f"regexp_replace({base}, {lit(U.EXT_RE)}, '\\1')"
    return f"(lower(substr({base}, length({stem}) + 1)) = '.pdf')"


BLOBS = f"""{ALL_PAGES},
blobs AS (
  SELECT {blob_name('sourcefile', 'page_num')} AS blob_name, sourcefile, page_num, text
  FROM allpages WHERE {is_pdf('sourcefile')}
  UNION ALL
  SELECT regexp_extract(sourcefile, '([^/]*)$', 1), sourcefile, 0, string_agg(text, '' ORDER BY page_num)
  FROM allpages WHERE NOT {is_pdf('sourcefile')}
  GROUP BY sourcefile)"""

ORACLE["page_blobs"] = f"""WITH {BLOBS}
SELECT blob_name, sourcefile, page_num::BIGINT AS page_num, text FROM blobs"""

ORACLE["remove_pages"] = f"""WITH {BLOBS},
gone AS (SELECT DISTINCT regexp_replace(CAST(conv_id AS VARCHAR) || '.pdf', {lit(U.EXT_RE)}, '\\1') AS stem
         FROM conversations WHERE role = 'system')
SELECT blob_name, sourcefile, page_num::BIGINT AS page_num, text FROM blobs
WHERE regexp_extract(blob_name, '^(.*)-[0-9]+\\.pdf$', 1) NOT IN (SELECT stem FROM gone)"""

INDEX = f"""{DOC_SECTIONS},
existing AS (SELECT id, content, NULL::VARCHAR AS category, sourcepage, sourcefile FROM sections),
incoming AS (SELECT id, content, category, sourcepage, sourcefile FROM sections WHERE category IS NOT NULL),
idx AS (SELECT * FROM incoming UNION ALL SELECT * FROM existing WHERE id NOT IN (SELECT id FROM incoming))"""

ORACLE["index_upsert"] = f"""WITH RECURSIVE {INDEX}
SELECT * FROM idx"""

ORACLE["index_delete"] = f"""WITH RECURSIVE {INDEX}
SELECT * FROM idx WHERE sourcefile NOT IN (
  SELECT CAST(doc_id AS VARCHAR) || '.txt' FROM labels WHERE toxic = 1)"""

ORACLE["index_lookup"] = f"""WITH RECURSIVE {INDEX}
SELECT *, (SELECT count(*) FROM idx)::BIGINT AS total_count FROM idx"""

ORACLE["index_facets"] = f"""WITH RECURSIVE {INDEX}
SELECT facet, value, count(*)::BIGINT AS count FROM (
  SELECT 'category' AS facet, category AS value FROM idx
  UNION ALL SELECT 'sourcepage', sourcepage FROM idx
  UNION ALL SELECT 'sourcefile', sourcefile FROM idx) WHERE value IS NOT NULL GROUP BY facet, value"""

ORACLE["content_postings"] = f"""WITH RECURSIVE {INDEX}
SELECT term, id, count(*)::BIGINT AS tf FROM (
  SELECT id, unnest(regexp_extract_all(lower(content), '\\p{{L}}+|\\p{{N}}+')) AS term FROM idx)
GROUP BY term, id"""


# The usual parameters of BM25, k1 = 1.2 and b = 0.75.
ORACLE["content_search"] = f"""WITH RECURSIVE {INDEX},
said AS (SELECT id, regexp_extract_all(lower(content), '\\p{{L}}+|\\p{{N}}+') AS t FROM idx WHERE content IS NOT NULL),
tot AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM said),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM said) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+|\\p{{N}}+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)))) AS score
      FROM q JOIN d USING (term) JOIN p USING (term), tot GROUP BY item_id, id)
SELECT item_id AS question_id, row_number() OVER w AS rank, id, round(score, 6) AS score FROM s
WINDOW w AS (PARTITION BY item_id ORDER BY round(score, 9) DESC, id) QUALIFY row_number() OVER w <= 10"""


# -------------------------------------------------------------- prompts
PROMPT_CTX = f"""{CONTEXT_CTE},
k AS (SELECT question_id, string_agg(text, chr(10) || chr(10) || '###' || chr(10) || chr(10) ORDER BY rn) AS context
      FROM run WHERE used <= 1800 GROUP BY question_id),
qc AS (SELECT b.item_id AS question_id, b.text AS question, coalesce(k.context, '') AS context
       FROM benchmark b LEFT JOIN k ON k.question_id = b.item_id)"""

INSTR = lit("Answer the question based on the context below, and if the question can't be answered "
            "based on the context, say \"I don't know\"")

ORACLE["chat_prompt"] = f"""WITH {PROMPT_CTX}
SELECT question_id, 'system' AS system_role, {INSTR} || chr(10) || chr(10) || 'Context: ' || context AS system_prompt,
       'user' AS user_role, 'Question: ' || question AS user_prompt,
       0.2::DOUBLE AS temperature, 150::BIGINT AS max_tokens, 0.8::DOUBLE AS top_p
FROM qc"""

ORACLE["completion_prompt"] = f"""WITH {PROMPT_CTX}
SELECT question_id, {INSTR} || chr(10) || chr(10) || 'Context: ' || context || chr(10) || chr(10) || '---'
       || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt,
       0.0::DOUBLE AS temperature, 150::BIGINT AS max_tokens, 1.0::DOUBLE AS top_p
FROM qc"""

ORACLE["questions_json"] = """SELECT item_id AS question_id,
       json_extract_string(json_object('query', text), '$.query') AS question FROM benchmark"""

EXPORT = f"""{chunks_cte()},
ex AS (SELECT doc_id, chunk_no, text, {tok('text')} AS n_tokens,
              CAST(to_json(list_transform({embed('text')}, lambda v: v::FLOAT)) AS VARCHAR) AS embeddings FROM chunks)"""

ORACLE["export_vectors"] = f"""WITH {EXPORT}
SELECT doc_id, chunk_no::BIGINT AS chunk_no, text, n_tokens::BIGINT AS n_tokens, embeddings FROM ex"""

ORACLE["parse_vectors"] = f"""WITH {EXPORT},
pv AS (SELECT doc_id, chunk_no, CAST(embeddings AS JSON)::DOUBLE[] AS vec FROM ex)
SELECT doc_id, chunk_no::BIGINT AS chunk_no, len(vec)::BIGINT AS dim,
       list_reduce(vec, lambda a, x: a + x, 0.0::DOUBLE) AS total FROM pv"""

ORACLE["csv_roundtrip"] = f"""WITH {CORPUS}
SELECT fname AS title, text FROM corpus"""


# ------------------------------------------------------------ tag lines
VOID = "area base br col embed hr img input link meta param source track wbr".split()

TOKEN_RE = r"</?[a-zA-Z][^>]*>|[^<]+|<"
NAME_RE = r"^</?([a-zA-Z][^\t\n\r\f />]*)"
VOID_LIST = "[" + ", ".join(lit(t) for t in sorted(VOID)) + "]"
PRINT_LIST = "[" + ", ".join(lit(t) for t in PRINT_TAGS) + "]"


def _kind(t: str) -> str:
    name = f"lower(regexp_extract({t}, {lit(NAME_RE)}, 1))"
    return (f"(CASE WHEN regexp_matches({t}, '^<[a-zA-Z]') THEN "
            f"(CASE WHEN ends_with({t}, '/>') OR list_contains({VOID_LIST}, {name}) THEN 'v' ELSE 's' END) "
            f"WHEN regexp_matches({t}, '^</[a-zA-Z]') THEN 'e' ELSE 't' END)")


_NAMES = "list_transform(st.stack, lambda z: z.name)"
_TOP = f"(len(st.stack) - list_position(list_reverse({_NAMES}), x.name) + 1)"

ORACLE["tag_lines"] = f"""WITH {SITE},
b AS (SELECT page_id, bs, bn,
             regexp_replace({body(remove_elements('html'))}, {lit(H.CLASS_ATTR_RE)}, '', 'g') AS b FROM site),
s AS (SELECT page_id, {rewrite_hrefs('b', 'bs', 'bn')} AS h FROM b),
tk AS (SELECT page_id, regexp_extract_all(h, {lit(TOKEN_RE)}) AS t FROM s),
cls AS (SELECT page_id, t, len(t) AS n,
               list_transform(range(1, len(t) + 1), lambda k: struct_pack(
                   i := k, kind := {_kind('t[k]')},
                   name := lower(regexp_extract(t[k], {lit(NAME_RE)}, 1)))) AS toks FROM tk),
folded AS (SELECT page_id, t, n, list_reduce(toks, lambda st, x: CASE
      WHEN x.kind = 's' THEN struct_pack(stack := list_append(st.stack, struct_pack(i := x.i, name := x.name)),
                                         ends := st.ends)
      WHEN x.kind = 'v' THEN struct_pack(stack := st.stack,
                                         ends := list_append(st.ends, struct_pack(i := x.i, e := x.i + 1)))
      WHEN x.kind = 'e' AND list_contains({_NAMES}, x.name) THEN struct_pack(
             stack := st.stack[1:{_TOP} - 1],
             ends := list_concat(st.ends, list_transform(st.stack[{_TOP}:], lambda z: struct_pack(i := z.i, e := x.i))))
      ELSE st END,
      struct_pack(stack := []::STRUCT(i BIGINT, name VARCHAR)[], ends := []::STRUCT(i BIGINT, e BIGINT)[])) AS st
    FROM cls),
el AS (SELECT page_id, t, unnest(list_concat(st.ends, list_transform(st.stack, lambda z: struct_pack(i := z.i, e := n + 1))))
              AS sp FROM folded),
elem AS (SELECT page_id, sp.i AS i, sp.e AS e, t[sp.i] AS tag, lower(regexp_extract(t[sp.i], {lit(NAME_RE)}, 1)) AS name,
                {unescape(f"array_to_string(list_filter(t[sp.i + 1:sp.e - 1], lambda z: NOT regexp_matches(z, '^</?[a-zA-Z]')), '')")} AS txt
         FROM el),
lines AS (SELECT page_id, i,
                 CASE WHEN name = 'a' THEN {py_strip_sql('txt')} || ' ' || {href_value('tag')}
                      ELSE {py_strip_sql('txt')} END AS line
          FROM elem
          WHERE list_contains({PRINT_LIST}, name) AND (name <> 'a' OR regexp_matches(tag, {lit(H.HAS_HREF_RE)})))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::BIGINT AS line_no, line FROM lines"""


# --------------------------------------------------------------- layout
LAYOUT = """li AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS r, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem),
cell AS (
  SELECT k, 0 AS r, 0 AS c, 'columnHeader' AS kind, 'Part <no> & name' AS content, 0 AS p, 0 AS s, 0 AS q FROM (SELECT DISTINCT k FROM li)
  UNION ALL SELECT k, 0, 1, 'columnHeader', 'Qty', 0, 0, 0 FROM (SELECT DISTINCT k FROM li)
  UNION ALL SELECT k, r, 0, 'content', CAST(p AS VARCHAR), p, s, q FROM li
  UNION ALL SELECT k, r, 1, 'content', CAST(q AS VARCHAR), p, s, q FROM li),
html AS (SELECT k, r, c, p, s, q, CASE WHEN kind = 'columnHeader' THEN 'th' ELSE 'td' END AS tag,
                replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM cell),
rows AS (SELECT k, r, string_agg('<' || tag || '>' || text || '</' || tag || '>', '' ORDER BY c, p, s, q) AS cells FROM html GROUP BY k, r),
every AS (SELECT k, unnest(range(0, max(r) + 1)) AS r FROM li GROUP BY k),
tab AS (SELECT k, '<table>' || string_agg('<tr>' || coalesce(cells, '') || '</tr>', '' ORDER BY r) || '</table>' AS html
  FROM every LEFT JOIN rows USING (k, r) GROUP BY k)"""

ORACLE["layout_cells"] = f"""WITH {LAYOUT}
SELECT 'order-' || CAST(k AS VARCHAR) || '.pdf' AS sourcefile, 0::BIGINT AS table_id, r::BIGINT AS row_index,
       c::BIGINT AS column_index, kind, content FROM cell"""

ORACLE["table_html"] = f"""WITH {LAYOUT}
SELECT 'order-' || CAST(k AS VARCHAR) || '.pdf' AS sourcefile, html FROM tab"""

ORACLE["layout_overlay"] = f"""WITH {LAYOUT}
SELECT 'order-' || CAST(k AS VARCHAR) || '.pdf' AS sourcefile, 0::BIGINT AS page_num,
       'Order ' || CAST(k AS VARCHAR) || ': ' || html || ' End. ' AS text FROM tab"""

ORACLE["route_pages"] = """WITH t AS (SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'application/pdf'
       WHEN contains(url, '/es/') THEN 'image/png' ELSE 'text/html; charset=utf-8' END AS content_type FROM pages)
SELECT page_id, content_type, CASE WHEN content_type = 'application/pdf' THEN 'pdf' ELSE 'html' END AS route
FROM t WHERE content_type <> 'image/png'"""

ORACLE["frontier_graph"] = """WITH RECURSIVE e AS (
  SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
walk(url, depth) AS (
  SELECT 's' || s_suppkey, 1 FROM supplier WHERE s_acctbal < 0
  UNION
  SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.url WHERE w.depth < 4)
SELECT url, min(depth)::BIGINT AS depth FROM walk GROUP BY url"""

ORACLE["frontier_resume"] = ORACLE["frontier_graph"]

_SECTIONS = ORACLE["section_pages"]
_CUT = _SECTIONS.rindex("\nSELECT ")
ORACLE["prepare_add"] = f"""{_SECTIONS[:_CUT]}
SELECT sourcefile, count(*)::BIGINT AS sent, count(*)::BIGINT AS succeeded FROM spans GROUP BY sourcefile"""

ORACLE["prepare_remove"] = f"""{_SECTIONS[:_CUT]}
SELECT id, content, 'chat' AS category, sourcepage, sourcefile FROM ({_SECTIONS[_CUT:]})
WHERE sourcefile NOT IN (SELECT CAST(conv_id AS VARCHAR) || '.pdf' FROM conversations WHERE role = 'system')"""

ORACLE["answers"] = f"""SELECT item_id AS question_id,
       CASE WHEN length(text) > 120 THEN '' ELSE {py_strip_sql('text')} END AS answer,
       CASE WHEN length(text) > 120 THEN 'ValueError: too long' END AS answer_error FROM benchmark"""
