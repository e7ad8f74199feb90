"""Corpus and chunk operators: corpus rows, token counts, greedy
sentence packing, token histograms. All row-local (no shuffle) except
the histogram, which is one global min/max plus one small group-by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX

MAX_TOKENS = 500      # chunk limit, in units of the token counter


def corpus(docs: DataFrame, fname_col: str = "fname", text_col: str = "text",
           literal_newlines: bool = False) -> DataFrame:
    """Corpus row text = ``fname + ". " + flattened text``."""
    return docs.withColumn(
        "text", F.concat(F.col(fname_col), F.lit(". "),
                         TX.flatten_newlines(text_col, literal_newlines)))


def with_token_count(df: DataFrame, text_col: str = "text", out: str = "n_tokens",
                     counter: TX.TokenCounter | None = None) -> DataFrame:
    return df.withColumn(out, TX.token_count(text_col, counter))


def _bound(value, fn):
    """``fn(value)`` with the value computed once: what a lambda names more
    than once, or once for each element, is otherwise computed each time."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def cut_tokens(text, size: int):
    """ARRAY<STRING> of pieces of at most ``size`` tokens of the default
    counter (in its own order, blanks kept), which join to the whole text."""
    units = F.regexp_extract_all(text, F.lit(r"[\t\n\x0B\f\r ]*(?:" + TX.TOKEN_PATTERN + r")|[\t\n\x0B\f\r ]+$"), 0)

    def pieces(u):
        last = F.floor((F.size(u) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(u, i * size + 1, F.lit(size)), ""))
    return _bound(units, pieces)


def pack_borders(costs, max_tokens: int):
    """ARRAY<INT> of the sentences (from 0) before which the open chunk is
    closed: the running total plus their cost is over ``max_tokens``. A
    sentence costs one more once kept; one over the limit leaves nothing open.
    The fold holds a number and the borders, no text."""
    init = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("at"))

    def step(acc, c):
        flush = acc["n"] + c > max_tokens
        n = F.when(c > max_tokens, F.lit(0).cast("long")).when(flush, c + F.lit(1).cast("long")).otherwise(acc["n"] + c + 1)
        return F.struct((acc["i"] + 1).alias("i"), n.alias("n"), F.when(flush, F.array_append(acc["at"], acc["i"])).otherwise(acc["at"]).alias("at"))
    return F.aggregate(costs, init, step, lambda acc: acc["at"])


def pack_sentences(text, max_tokens: int = MAX_TOKENS, lossless: bool = True,
                   counter: TX.TokenCounter | None = None, keep_tail: bool = False):
    """ARRAY<STRING> of chunks of ``text``, packed greedily by sentence.

    Sentences are split on ". "; a sentence costs the tokens of
    ``" " + sentence`` and takes one more token once kept. Before each
    sentence: if the running total plus its cost is over ``max_tokens``
    the open chunk is closed (``". ".join(sentences) + "."``). A sentence
    over ``max_tokens`` is cut into chunks of fewer tokens, and the open
    chunk at the end is kept, so no text is lost.

    ``lossless=False`` drops both: a sentence over ``max_tokens``
    vanishes (closing an empty chunk then yields "."), and so does the
    open chunk at the end, unless ``keep_tail``.

    JVM-side: a fold finds the borders (``pack_borders``); each chunk is a
    slice of the sentences, joined once."""
    counter = counter or TX.DEFAULT_COUNTER

    def joined(sent, start, end):
        return F.concat(F.array_join(F.slice(sent, start + 1, end - start), ". "), F.lit("."))

    def chunks_of(p):
        sent, cost, at = p["s"], p["c"], p["at"]
        none = F.array().cast("array<string>")

        def begins(k):
            """First sentence of what border ``k`` leaves open (-1: the text's begin)."""
            border = F.get(at, k)
            return F.when(k < 0, F.lit(0)).otherwise(border + F.when(F.get(cost, border) > max_tokens, 1).otherwise(0))

        def closed(border, k):
            start = begins(k - 1)
            filled = F.array(joined(sent, start, border))
            if not lossless:
                return filled
            over = F.get(cost, border) > max_tokens
            return F.concat(F.when(border > start, filled).otherwise(none),
                            F.when(over, cut_tokens(F.get(sent, border), max_tokens - 1)).otherwise(none))
        done = F.flatten(F.transform(at, closed))
        if not (lossless or keep_tail):
            return done
        last = begins(F.size(at) - 1)
        return F.when(F.size(sent) > last, F.array_append(done, joined(sent, last, F.size(sent)))).otherwise(done)

    # the costs stand outside every lambda: a counter may be a Python UDF
    sent = TX.split_sentences(text)
    cost = counter.count_each(F.transform(TX.split_sentences(text), lambda x: F.concat(F.lit(" "), x)))
    with_borders = _bound(F.struct(sent.alias("s"), cost.alias("c")), lambda p: F.struct(
        p["s"].alias("s"), p["c"].alias("c"), pack_borders(p["c"], max_tokens).alias("at")))
    return _bound(with_borders, chunks_of)


def chunks(corpus_df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           max_tokens: int = MAX_TOKENS, lossless: bool = True,
           counter: TX.TokenCounter | None = None, keep_tail: bool = False) -> DataFrame:
    """(id, chunk_no, text, n_tokens): texts over ``max_tokens`` are
    packed into sentence chunks, shorter ones kept whole; NULL texts are
    skipped. Row-local: a posexplode, no shuffle."""
    counter = counter or TX.DEFAULT_COUNTER
    src = corpus_df.filter(F.col(text_col).isNotNull())
    src = src.withColumn("_n", counter.count(F.col(text_col)))
    # a text kept whole already has its count; only packed chunks are recounted
    packed = F.transform(pack_sentences(F.col(text_col), max_tokens, lossless, counter, keep_tail),
                         lambda t: F.struct(t.alias("t"), F.lit(None).cast("int").alias("n")))
    whole = F.array(F.struct(F.col(text_col).alias("t"), F.col("_n").cast("int").alias("n")))
    parts = F.when(F.col("_n") > max_tokens, packed).otherwise(whole)
    out = src.select(F.col(id_col), F.posexplode(parts).alias("chunk_no", "p"))
    return out.select(id_col, "chunk_no", F.col("p.t").alias("text"),
                      F.coalesce(F.col("p.n"), counter.count(F.col("p.t"))).alias("n_tokens"))


def token_histogram(df: DataFrame, col: str = "n_tokens", bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), all bins
    listed, empty ones with count 0; a single distinct value falls in the
    middle bin as in numpy. (bin 1-based, lo, hi, count).

    One pass over the data: per-value counts (partially aggregated),
    then min/max and binning on that small table; the value-count
    exchange is reused by both branches."""
    v = F.col(col).cast("long")
    counts = df.select(v.alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    # sum(c) keeps the optimiser from folding min/max back onto the raw
    # rows, so both branches share the one value-count exchange
    stats = (counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("_n"))
                   .select(F.when(F.col("_n") > 0, F.col("lo")).alias("lo"),
                           F.when(F.col("_n") > 0, F.col("hi")).alias("hi")))
    # one-row frame: broadcasting it is bounded by construction
    idx = (F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2 + 1))
            .otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1,
                               F.lit(bins))))
    binned = (counts.crossJoin(F.broadcast(stats))
                .select(idx.cast("long").alias("bin"), "c").groupBy("bin").agg(F.sum("c").alias("n")))
    all_bins = stats.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return (all_bins.withColumn("bin", F.col("bin").cast("long"))
            .join(F.broadcast(binned), "bin", "left")
            .select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("count")))
