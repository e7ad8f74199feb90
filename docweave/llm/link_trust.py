"""URL verdicts from rules and from trust that spreads over links.

Rules. A rule is a host and a path; it fits a URL whose host is the rule's or
a subdomain of it and whose path starts with the rule's; the longest decides.

Link graph. Absolute links in the pages' HTML give host edges, weighted by
their count. Trust is a personalised PageRank that restarts at the hosts of
allowed pages, distrust one over the reversed edges that restarts at the hosts
of blocked pages (who links to a blocked host is suspect); a restart falls on
a host in proportion to its pages. Both run in one table of (kind, host,
score): a round is one join with the edges and one sum, until nothing moves.
The mass of hosts without edges restarts. Where no rule fits, a page is blocked if its host's
distrust is over ``RATIO`` times its trust, both as shares of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ascii_lower, discard, small, stage

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Rounds end when no host's score grows by a larger part of itself.
CLOSE = 1e-6
LEAST = 1e-300
RATIO = 2.0
#: Absolute and scheme-relative links in attributes; group 1 is the host.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null and without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` of ``(host, html)``, without links of a host to itself."""
    links = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1))
    return (pages.filter("host <> ''").select(F.col("host").alias("src"), links.alias("dst"))
            .select("src", ascii_lower(F.col("dst")).alias("dst")).filter("src <> dst AND dst <> ''")
            .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, close: float = CLOSE) -> DataFrame:
    """``kind, host, score`` of ``seeds`` (``kind, host, weight``) over
    ``edges``: 'trust' along them, 'distrust' against them. Scores of a kind
    sum to one.

    The fixed point is the sum of what restarts and all it passes on, scaled
    to one (mass of hosts without edges restarts, which only scales). Each
    round adds what the one before passed on, until that is at most ``close``
    times the score of every host. A host reached for the first time has
    nothing else, so rounds go on until no host is new, however long the
    chains are; what is passed on never vanishes in rounding."""
    own = seeds.groupBy("kind", "host").agg(F.sum("weight").alias("weight"))
    start = stage(own.join(F.broadcast(own.groupBy("kind").agg(F.sum("weight").alias("all"))), "kind")
                  .select("kind", "host", (F.col("weight") / F.col("all")).alias("score")))
    if edges.isEmpty():
        return start
    both = (edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight")
            .union(edges.select(F.lit("distrust"), "dst", "src", "weight")))
    out = both.groupBy("kind", "host").agg(F.sum("weight").alias("out"))
    steps = stage(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("out") * damping).alias("part")))
    state, old = start.withColumn("moved", F.col("score")), start
    while True:
        moved = (state.filter("moved > 0").join(steps, ["kind", "host"]).groupBy("kind", F.col("to").alias("host"))
                 .agg(F.greatest(F.sum(F.col("moved") * F.col("part")), F.lit(LEAST)).alias("moved")))
        none = F.lit(0.0)
        new = stage(state.drop("moved").join(moved, ["kind", "host"], "full")
                    .select("kind", "host", (F.coalesce("score", none) + F.coalesce("moved", none)).alias("score"), F.coalesce("moved", none).alias("moved")))
        discard(old)
        state = old = new
        if (state.agg(F.max(F.col("moved") / F.col("score"))).first()[0] or 0.0) <= close:
            total = state.groupBy("kind").agg(F.sum("score").alias("total"))          # a row for each kind
            return state.join(F.broadcast(total), "kind").select("kind", "host", (F.col("score") / F.col("total")).alias("score"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
          ratio: float = RATIO) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, trust,
    distrust`` (of the host).

    A null URL, or one without ``://``, has empty host and path, no rule and
    no scores, and so is allowed; null HTML has no links; repeated rows get a
    row each and count again; null ids are carried; an empty table gives no
    rows; other columns are not read."""
    url = F.col(url_col).cast("string")
    seen = (pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")))
    ruled = stage(seen.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
                  .select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("by_rule")))
    edges = stage(host_edges(seen))
    seeds = (ruled.filter("by_rule IS NOT NULL").groupBy(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
             .agg(F.count("*").cast("double").alias("weight")))
    score = spread(seeds, edges)
    trust = F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0))
    distrust = F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0))
    hosts = stage(score.groupBy(F.col("host").alias("scored")).agg(trust.alias("trust"), distrust.alias("distrust")))
    rows = ruled.join(small(hosts), ruled["host"] == F.col("scored"), "left")
    none = F.lit(0.0)
    bad = F.coalesce("distrust", none) > F.coalesce("trust", none) * ratio
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                       F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))
