"""Quality classifier by importance resampling over hashed n-grams.

Tokens are runs of letters and digits (and other non-ASCII characters) and
runs of other visible characters, A-Z lower-cased; their unigrams and bigrams
fall into ``BUCKETS`` hash buckets. Two bags of buckets are generative models:
the raw one counts every n-gram of all documents; the target one counts those
of the clean labelled documents (quality 1, not toxic) of the target half of
a bounded labelled sample, in which an id has one vote that its different texts
share: copies and repeats of an id do not move the models or the cut. A document's log importance weight is the mean log
ratio of target to raw over its n-grams, times ``LENGTH`` (the weight of
``LENGTH`` n-grams of it, so long and short documents compare).

Gumbel top-k: a standard Gumbel variate, drawn from a hash of id and text, is
added to each weight and the k largest stay, which samples k documents without
replacement in proportion to their weights. k is the number of documents with
a weight of at least the cut that best tells the clean from the low-quality
documents of the sample's other half.

A mean over a document hides a few harmful words, so harm has a ratio of its
own, toxic to other labelled documents of the sample, over 64-bit n-grams
(no buckets, so no collisions): an n-gram that toxic documents hold and others
hardly do is marked. A document's harm is the sum of the log ratios of its
marked n-grams; where that puts the odds of being toxic at ``HARM_ODDS`` or
more, ``LENGTH`` times the harm comes off the weight, whatever the document's
length. On both sides a text counts once, however many labelled documents hold
it (texts that differ in A-Z case or white space are one; it is toxic if any of
them is). A mark needs a share of toxic texts of ``PURE`` and odds against
chance of ``ODDS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import LOWER, WORD_PUNCT, ascii_lower, gram_hashes, joined, row_blocks, span_hashes, spans, stage, text_bytes, unit_uniform
from docweave.llm.keep import row_key

BUCKETS = 1 << 16
LENGTH = 256
SMOOTH = 1.0
BLOCK = 1 << 18
#: Bound on the labelled rows that are used, one for each id and text: the ids
#: with the least hashes and the least text of each, then their other texts,
#: both by hash.
LABELLED = 20_000
#: A whole vote. Votes are whole numbers, so sums are the same in any order.
VOTE = 1 << 24
PURE = 0.9
ODDS = 1e7
HARM_ODDS = 100
#: A share of clean documents lost weighs as much as this many times that share of bad ones kept.
CLEAN = 10


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts, of at most ``BLOCK`` bytes or one text: first, end and,
    flat, the n-gram hashes with their text."""
    i = 0
    for part in row_blocks(pa.RecordBatch.from_arrays([column], ["text"]), "text", BLOCK):
        texts = text_bytes(part.column(0))
        j = i + len(texts)
        buf, at = joined(texts)
        starts, ends = spans(buf, WORD_PUNCT)
        h = span_hashes(buf, starts, ends, LOWER)
        doc = np.searchsorted(at, starts, "right") - 1
        pair = gram_hashes(h, 2)
        same = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
        yield i, j, np.concatenate((h, pair[same])), np.concatenate((doc, doc[:-1][same] if len(doc) else doc))
        i = j


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over ``(text)`` of n-grams, over ``(text, vote)`` of their votes."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        vote = batch.column(1).to_numpy() if batch.num_columns > 1 else None
        for i, j, grams, doc in _features(batch.column(0)):
            weights = None if vote is None else vote[i:j][doc].astype(float)
            n += np.bincount(_bucket(grams), weights, BUCKETS).astype(np.int64)
    own = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], ["bucket", "n"])


def labelled_sample(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids: ``doc_id, clean, half`` (null labels
    are left out; of contradicting rows the worse counts)."""
    worst = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")))
    order = F.xxhash64("doc_id", F.lit("sample"))
    return (worst.orderBy(order, "doc_id").limit(limit)
            .select(F.col("doc_id").alias("label_id"), "quality", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def labelled_rows(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` rows for the ids of ``labelled_sample`` (staged), one
    for each id and text: ``label_id, label_key, quality, toxic, half, vote``.
    The texts of an id share its vote."""
    own = _keyed(docs, id_col, text_col).select("doc_id", "row_key").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    rows = stage(own.groupBy("label_id", F.col("row_key").alias("label_key"))
                 .agg(F.first("quality").alias("quality"), F.first("toxic").alias("toxic"), F.first("half").alias("half")))
    if rows.count() > limit:
        place = F.struct(F.xxhash64("label_id", "label_key"), "label_key")
        first = stage(rows.groupBy(F.col("label_id").alias("id")).agg(F.min(place).alias("first")))
        later = (place != F.col("first")).cast("int")
        rows = stage(rows.join(F.broadcast(first), F.col("label_id") == F.col("id"))
                     .orderBy(later, F.xxhash64("label_id", "label_key"), "label_id", "label_key").limit(limit).select(*rows.columns))
    n = rows.groupBy(F.col("label_id").alias("id")).agg(F.count("*").alias("n"))
    return stage(rows.join(F.broadcast(n), F.col("label_id") == F.col("id"))
                 .select(*rows.columns, F.floor(F.lit(VOTE) / F.col("n")).alias("vote")))


def _in_sample(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of ``df`` (``doc_id, row_key, ...``) that the sample of
    ``labelled_rows`` holds, with its columns."""
    return df.join(F.broadcast(sample), (F.col("doc_id") == F.col("label_id")) & (F.col("row_key") == F.col("label_key")))


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``labelled_rows`` with their texts, staged: ``text, quality, toxic, half, vote``."""
    rows = (_in_sample(_keyed(docs, id_col, text_col), sample).groupBy("doc_id", "row_key")
            .agg(*[F.min(c).alias(c) for c in ("text", "quality", "toxic", "half", "vote")]))
    return stage(rows.drop("doc_id", "row_key"))


def log_ratio(docs: DataFrame, labelled: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw model for each bucket. ``BUCKETS`` rows come
    to the driver, whatever the input."""
    def sums(texts):
        out = np.zeros(BUCKETS)
        for r in texts.mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r["bucket"]] = r["n"]
        return out
    target = sums(labelled.filter("quality = 1 AND toxic = 0 AND half = 0").select("text", "vote")) / VOTE
    if not target.any():
        return np.zeros(BUCKETS)
    raw = sums(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    model = [np.log((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS)) for c in (target, raw)]
    return model[0] - model[1]


def _doc_grams(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct n-grams of each text, as signed 64-bit numbers in ascending order."""
    for i, j, grams, doc in _features(column):
        order = np.argsort(doc, kind="stable")
        for own in np.split(grams.view(np.int64)[order], np.cumsum(np.bincount(doc, minlength=j - i))[:-1]):
            yield np.unique(own)


def _distinct_texts(labelled: DataFrame) -> DataFrame:
    """One row per text of ``(text, toxic, vote)``, with its largest vote; all
    that is no token separates tokens alike, so rows of one text have the same n-grams."""
    same = F.xxhash64(F.trim(F.regexp_replace(ascii_lower(F.col("text")), r"[\x00-\x20\x7f]+", " ")))
    return (labelled.groupBy(same.alias("same"))
            .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("vote").alias("vote")).drop("same"))


def _toxic_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, vote in zip(_doc_grams(batch.column(0)), batch.column(1).to_pylist()):
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), vote))], ["gram", "n"])


def _holders(candidates: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(candidates), np.int64)
        for batch in batches:
            for own, vote in zip(_doc_grams(batch.column(0)), batch.column(1).to_pylist()):
                at = np.searchsorted(candidates, own)
                at[at == len(candidates)] = 0
                n[at[candidates[at] == own]] += vote
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(candidates[held]), pa.array(n[held])], ["gram", "n"])
    return count


def chance_odds(toxic: float, other: float, share: float) -> float:
    """Log odds against chance that ``toxic`` of ``toxic + other`` holders are
    toxic, where a share ``share`` of all documents is."""
    ways = math.lgamma(toxic + other + 1) - math.lgamma(toxic + 1) - math.lgamma(other + 1)
    return -toxic * math.log(share) - ways


def harm_ratio(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Marked n-grams in ascending order, the log ratio of each, and the harm
    from which on a document's odds are ``HARM_ODDS``. What comes
    to the driver are n-grams of at least ``least`` labelled toxic texts:
    their number is bounded by the sample, not by the corpus."""
    texts = stage(_distinct_texts(labelled))
    toxic, other = texts.filter("toxic = 1").select("text", "vote"), texts.filter("toxic = 0").select("text", "vote")
    n_toxic, n_other = ((df.agg(F.sum("vote")).first()[0] or 0) / VOTE for df in (toxic, other))
    none = np.zeros(0, np.int64), np.zeros(0), 0.0
    if not n_toxic or not n_other:
        return none
    share = n_toxic / (n_toxic + n_other)
    least = math.ceil(math.log(ODDS) / -math.log(share))
    held = (toxic.mapInArrow(_toxic_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            .filter(F.col("n") > (least - 1) * VOTE).collect())
    if not held:
        return none
    by_toxic = {r["gram"]: r["n"] / VOTE for r in held}
    by_other = {r["gram"]: r["n"] / VOTE for r in other.mapInArrow(_holders(np.array(sorted(by_toxic), np.int64)), "gram long, n long")
                .groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    marked = {}
    for gram, a in by_toxic.items():
        b = by_other.get(gram, 0)
        if a >= PURE * (a + b) and chance_odds(a, b, share) >= math.log(ODDS):
            marked[gram] = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_other + 1))
    grams = sorted(marked)
    prior = math.log(n_toxic / n_other)
    return np.array(grams, np.int64), np.array([marked[g] for g in grams]), math.log(HARM_ODDS) - prior


def _weight_udf(ratio: np.ndarray, marked: np.ndarray, harm: np.ndarray, least: float):
    table = ratio.astype(np.float32)
    maybe = np.zeros(BUCKETS, bool)
    maybe[_bucket(marked.view(np.uint64))] = True

    @F.arrow_udf("double")
    def weight(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for i, j, grams, doc in _features(text):
            bucket = _bucket(grams)
            n = np.bincount(doc, minlength=j - i)
            total = np.bincount(doc, weights=table[bucket], minlength=j - i)
            out[i:j] = LENGTH * total / np.maximum(n, 1)
            if len(marked):
                seen = np.flatnonzero(maybe[bucket])
                own = grams[seen].view(np.int64)
                at = np.minimum(np.searchsorted(marked, own), len(marked) - 1)
                hit = marked[at] == own
                total = np.bincount(doc[seen[hit]], weights=harm[at[hit]], minlength=j - i)
                out[i:j] -= LENGTH * np.where(total >= least, total, 0)
        return pa.array(out)
    return weight


def _gumbel():
    return -F.log(-F.log(unit_uniform("doc_id", "row_key", F.lit("gumbel"))))


def best_cut(clean: list[float], bad: list[float], clean_votes: list[int] | None = None, bad_votes: list[int] | None = None) -> float:
    """Weight at which ``CLEAN`` times the share of clean documents at or above
    it plus the share of bad ones below it is greatest (midway between two
    values). Shares are of votes, by default one for each document."""
    if not clean or not bad:
        return float("-inf")

    def below(values, votes):
        order = np.argsort(values, kind="stable")
        total = np.concatenate(([0], np.cumsum(np.ones(len(values), np.int64) if votes is None else np.array(votes)[order])))
        return total[np.searchsorted(np.array(values)[order], cuts)] / total[-1]
    v = np.unique(np.concatenate((clean, bad)))
    cuts = np.concatenate(([v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]))
    gain = CLEAN * (1 - below(clean, clean_votes)) + below(bad, bad_votes)
    return float(cuts[np.argmax(gain)])


def kth_largest(df: DataFrame, col: str, k: int, enough: int = 10_000) -> float:
    """Exact k-th largest value (k from 1) by counting in bins and narrowing;
    at most 4096 counters or ``enough`` values come to the driver at a time."""
    part = df.select(F.col(col).alias("x"))
    lo, hi, n = part.agg(F.min("x"), F.max("x"), F.count("x")).first()
    while n > enough and lo < hi:
        b = F.least(F.floor((F.col("x") - lo) / (hi - lo) * 4096), F.lit(4095))
        bins = sorted(part.groupBy(b.alias("b")).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
                      .collect(), key=lambda r: -r["b"])
        for r in bins:
            if k <= r["n"]:
                break
            k -= r["n"]
        lo, hi, n = r["lo"], r["hi"], r["n"]
        part = part.filter(F.col("x").between(lo, hi))
    if lo == hi:
        return lo
    return sorted((r["x"] for r in part.collect()), reverse=True)[k - 1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, float]:
    """Scores of all documents (staged: ``doc_id, row_key, log_weight,
    sample_key``), a function of (docs) that adds them, and the key from which on rows stay."""
    sample = labelled_rows(docs, stage(labelled_sample(labels)), id_col, text_col)
    labelled = labelled_texts(docs, sample, id_col, text_col)
    weight = _weight_udf(log_ratio(docs, labelled, text_col), *harm_ratio(labelled))

    scored = stage(_keyed(docs, id_col, text_col).withColumn("log_weight", weight("text")).drop("text")
                   .withColumn("sample_key", F.col("log_weight") + _gumbel()))
    half = (_in_sample(scored, sample.filter("half = 1")).groupBy("doc_id", "row_key")
            .agg(*[F.min(c).alias(c) for c in ("quality", "toxic", "log_weight", "vote")]).collect())
    clean, bad = [r for r in half if r["quality"] == 1 and r["toxic"] == 0], [r for r in half if r["quality"] == 0]
    cut = best_cut(*[[r["log_weight"] for r in rows] for rows in (clean, bad)], *[[r["vote"] for r in rows] for rows in (clean, bad)])
    k = scored.filter(F.col("log_weight") >= F.lit(cut)).count()
    least = kth_largest(scored, "sample_key", k) if k else float("inf")
    return scored, weight, least


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, log_weight, sample_key, keep``.

    Null and empty texts have weight 0; repeated rows have the same key and
    fate (at the cut, rows with equal keys all stay); a null id is scored like
    any other; without labelled documents, or without low-quality ones, all
    rows stay; an empty table gives no rows; other columns are not read."""
    scored, _, least = fit(docs, labels, id_col, text_col)
    return scored.select("doc_id", "log_weight", "sample_key", (F.col("sample_key") >= F.lit(least)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``classify`` keeps; all columns stay. The weight
    is computed again in place, which is cheaper than joining whole texts."""
    _, weight, least = fit(docs, labels, id_col, text_col)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    noise = -F.log(-F.log(unit_uniform(docs[id_col].cast("long"), row_key(docs[text_col]), F.lit("gumbel"))))
    return docs.filter(weight(text) + noise >= F.lit(least))
