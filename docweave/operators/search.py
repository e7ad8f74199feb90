"""Ranked search over ``content``: BM25 from postings, exact top-k.

An index is three tables: postings (term, id and the weight of the term in the
text), terms (document frequency and largest weight) and one row of totals.
A built index holds the postings by text, a row with the distinct terms and
their counts for each: about two thirds of the compressed input, where a row
for each posting is several times the input. Searched as built, no posting
moves: texts are scored where they are. Postings are stored in buckets by a
hash of the term; a term in very many texts is salted by id over several
parts, so that neither a write nor a join has a task for it alone.

A query's terms need not all be followed through all their postings. The
scores from its rarest terms give a score that the k-th result reaches at
least. Its most frequent terms, as far as their largest possible weights
together stay below that score, cannot bring in a text alone: they only add to
texts that another term found and that can still reach the k-th best of the
scores so far.

The postings of the wanted terms, unless they lie by text, are dealt by id, each
once however many queries ask for its term. A task adds up the scores of its
texts for a block of queries at a time, and only the texts that may be among the
best leave it: what moves does not grow with queries times texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_staged, stage_table
from .index import FEW_IDS, term_runs, terms_of

K1, B = 1.2, 0.75
BUCKETS = 64
#: Postings of a term in one part.
HOT = 1_000_000
#: Postings that a query's rarest terms have together before its threshold is taken from them, for each result wanted.
SEED = 4
#: Scores are sums in no fixed order: results are ordered by the score rounded to so many digits, and bounds loosened by more.
DIGITS, SLACK = 9, 1e-6
#: Queries of one pass over the postings, and scores (texts times queries) and parts of scores that a task holds at a time.
QUERIES, CELLS, PARTS = 1000, 1 << 20, 1 << 21


@dataclass
class SearchIndex:
    postings: DataFrame          # term, salt, id, weight (bucket where stored)
    terms: DataFrame             # term, df, top, parts
    n: int
    texts: DataFrame | None = None       # id, len, terms (joined by blanks), tfs: postings by text, a text with an id of its own a row
    loose: DataFrame | None = None       # term, id, weight: postings of the texts that share their ids
    rule: tuple[float, float, float] = (K1, B, 1.0)      # k1, b and the average length


def _weight(tf, length, rule: tuple[float, float, float]):
    """Of a term in a text, for columns and arrays alike."""
    k1, b, avg = rule
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def _by_term(texts: DataFrame) -> DataFrame:
    """``term, id, len, tf`` of texts that are a row each."""
    return (texts.select("id", "len", "tfs", F.posexplode(F.split("terms", " ")).alias("_at", "term"))
            .select("term", "id", "len", F.get("tfs", "_at").alias("tf")))


def build(index: DataFrame, id_col: str = "id", text_col: str = "content", k1: float = K1, b: float = B, hot: int = HOT) -> SearchIndex:
    """Postings, by text, and term table of ``index``, staged in the shared
    checkpoint folder; ``index`` is read once. A row whose text is missing is
    no document; ids are taken to be unique (rows of one id count as one longer
    text would not: each keeps its own length and weights)."""
    said = index.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), terms_of(text_col).alias("t"))
    runs = said.select("id", F.size("t").alias("len"), term_runs(F.col("t")).alias("r"))
    texts = stage_table(runs.select("id", "len", F.array_join("r.term", " ").alias("terms"), F.col("r.tf").cast("array<int>").alias("tfs")), small=True)
    total = texts.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    rule = (k1, b, float(total["avg"] or 0.0) or 1.0)
    texts, loose = _apart(texts, rule)
    postings = _by_term(texts).select("term", "id", _weight(F.col("tf"), F.col("len"), rule).alias("weight"))
    if loose is not None:
        postings = postings.unionByName(loose)
    parts = F.greatest(F.lit(1), F.ceil(F.col("df") / hot)).cast("int")
    terms = stage_table(postings.groupBy("term").agg(F.count("*").alias("df"), F.max("weight").alias("top")).withColumn("parts", parts), small=True)
    many = terms.filter("parts > 1").select("term", "parts")                       # few: n * length / hot of them
    if many.isEmpty():
        salted = postings.select("term", F.lit(0).alias("salt"), "id", "weight")
    else:
        salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")
        salted = postings.join(F.broadcast(many), "term", "left").select("term", salt.alias("salt"), "id", "weight")
    return SearchIndex(salted, terms, total["n"], texts, loose, rule)


def _apart(texts: DataFrame, rule: tuple[float, float, float]) -> tuple[DataFrame, DataFrame | None]:
    """The texts with terms that have an id of their own, and ``term, id,
    weight`` of the others if any: of one id and length the counts add up."""
    said = texts.filter("len > 0")
    again = texts.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("id").alias("_id"))
    many = again.limit(FEW_IDS + 1).count()
    if not many:
        return said, None
    again = stage_table(again)
    same = F.col("id").eqNullSafe(F.col("_id"))
    ids = F.broadcast(again) if many <= FEW_IDS else again
    counts = _by_term(said.join(ids, same, "left_semi")).groupBy("term", "id", "len").agg(F.sum("tf").alias("tf"))
    loose = stage_table(counts.select("term", "id", _weight(F.col("tf"), F.col("len"), rule).alias("weight")))
    alone = stage_table(said.join(ids, same, "left_anti"), small=True)
    drop_staged(texts, again)
    return alone, loose


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write(index: SearchIndex, path: str, buckets: int = BUCKETS) -> None:
    """Store an index. Rows are dealt by (bucket, salt), sorted by term in
    their files, so that a read of some terms skips buckets and row groups."""
    root = path.rstrip("/")
    rows = index.postings.withColumn("bucket", bucket_of("term", buckets))
    (rows.repartition(F.col("bucket"), F.col("salt")).sortWithinPartitions("bucket", "term", "id")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings"))
    index.terms.write.mode("overwrite").parquet(f"{root}/terms")
    spark = index.terms.sparkSession
    spark.range(1).select(F.lit(index.n).cast("long").alias("n"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{root}/about")


def read(spark: SparkSession, path: str) -> SearchIndex:
    root = path.rstrip("/")
    return SearchIndex(spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/terms"), spark.read.parquet(f"{root}/about").first()["n"])


def _found(index: SearchIndex, wanted: DataFrame) -> DataFrame:
    """``query_id, id, part``: what each posting of each wanted term gives.
    Where the postings lie by text, the wanted terms (of a block of queries) go
    to them. A salted term's row is repeated for each of its parts, so the
    join's keys are never hotter than ``HOT`` postings."""
    part = (F.col("gain") * F.col("weight")).alias("part")
    if index.texts is not None:
        return index.postings.drop("salt").join(F.broadcast(wanted.select("query_id", "term", "gain")), "term").select("query_id", "id", part)
    w = wanted.select("query_id", "term", "gain", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return index.postings.select("term", "salt", "id", "weight").join(w, ["term", "salt"]).select("query_id", "id", part)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("key").desc(), F.col("id").asc())
    return (scores.withColumn("key", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def query_terms(index: SearchIndex, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """``query_id, term, gain, most, df, parts`` of each distinct term of a
    query that the index knows: ``gain`` is its inverse document frequency
    times its count in the query, ``most`` the most it can add to a score."""
    t = queries.select("query_id", F.explode(terms_of(query_col)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (t.join(index.terms, "term").withColumn("gain", F.col("qtf") * idf)
            .select("query_id", "term", "gain", (F.col("gain") * F.col("top")).alias("most"), "df", "parts"))


def thresholds(index: SearchIndex, wanted: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """``query_id, floor``: a score that a query's k-th result reaches at least (from its rarest terms)."""
    w = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = wanted.withColumn("sum", F.sum("df").over(w)).filter(F.col("sum") - F.col("df") < k * seed)
    return _floors(_found(index, rare).groupBy("query_id", "id").agg(F.sum("part").alias("score")), k)


def _floors(scores: DataFrame, k: int) -> DataFrame:
    """``query_id, floor`` of the queries that have ``k`` texts with partial scores: the k-th best, less the slack."""
    return (_ranked(scores, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
            .filter(F.col("n") >= k).select("query_id", (F.col("low") - SLACK).alias("floor")))


def split_terms(wanted: DataFrame, floor: DataFrame) -> DataFrame:
    """``wanted`` with ``only_look_up`` (a query's most frequent terms, as far
    as they together stay below its floor), ``rest`` (what these can add at
    most) and ``floor``."""
    w = Window.partitionBy("query_id").orderBy(F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = wanted.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    t = t.withColumn("only_look_up", F.sum("most").over(w) < F.col("floor"))
    rest = F.sum(F.when(F.col("only_look_up"), F.col("most")).otherwise(0.0)).over(Window.partitionBy("query_id"))
    return t.withColumn("rest", rest)


def _lists(rows: list, terms: dict, queries: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries and gains of each term, one term after the other, and where each begins."""
    t, q = (np.array([of[r[c]] for r in rows], np.int64) for of, c in ((terms, "term"), (queries, "query_id")))
    order = np.argsort(t, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=len(terms)))))
    return at, q[order], np.array([r["gain"] for r in rows], np.float64)[order]


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of ``(id, term_no, weight)`` in order of id, none of them cut: ids, and text number, term and weight of each row."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        t = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks() if held or batch else None
        if t is None:
            return
        code = t["id"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        stop = t.num_rows if batch is None else int(first[-1])
        held = None
        if batch is not None:
            tail = t.slice(stop)                              # the last text may go on: its rows, each term once
            no, at = np.unique(tail["term_no"].to_numpy(), return_inverse=True)
            held = pa.RecordBatch.from_arrays([tail["id"].combine_chunks().take(pa.array(np.zeros(len(no), np.int64))), pa.array(no, pa.int32()),
                                               pa.array(np.bincount(at, tail["weight"].to_numpy()))], schema=batch.schema)
            first = first[:-1]
        if stop:
            doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, stop)))
            yield t["id"].combine_chunks().take(pa.array(first)), doc, t["term_no"].to_numpy()[:stop], t["weight"].to_numpy()[:stop]


def _texts_of(wanted: list[str], rule: tuple[float, float, float]):
    """Reads rows ``(id, len, terms, tfs)``, a text each: what ``_whole_texts`` gives."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        known = pa.array(wanted, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            split = pc.split_pattern(batch["terms"].cast(pa.string()), " ")
            no = pc.fill_null(pc.index_in(split.flatten(), known), -1).to_numpy()
            at = np.flatnonzero(no >= 0)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(split).to_numpy())[at]
            tf = batch["tfs"].flatten().to_numpy(zero_copy_only=False)[at]
            yield batch["id"], doc, no[at], _weight(tf, batch["len"].to_numpy()[doc], rule)
    return read


def _blocks(doc: np.ndarray, cost: np.ndarray, texts: int, most: int) -> Iterator[tuple[int, int]]:
    """First text and the one after the last of blocks of at most ``most`` texts, and of ``PARTS`` parts unless one text has more."""
    so_far, base = np.cumsum(np.bincount(doc, cost, texts)), 0
    while base < texts:
        end = int(np.searchsorted(so_far, (so_far[base - 1] if base else 0) + PARTS, "right"))
        yield base, (base := min(max(end, base + 1), base + most, texts))


def _scorer(read, follow, look_up, rest: np.ndarray, floor: np.ndarray, k: int):
    """``query_no, id, score`` of the texts of a partition that may be among
    the ``k`` best of a query: of equal scores the ``k`` smallest ids, and
    whatever is close enough to the ``k``-th best to round to the same."""
    many, tie = len(rest), 2 * 10.0 ** -DIGITS
    asked = np.diff(follow[0]) + np.diff(look_up[0])          # queries of each term

    def parts(lists, doc, term, weight):
        at, query, gain = lists
        n = at[term + 1] - at[term]
        i = np.arange(n.sum()) + np.repeat(at[term] - (np.cumsum(n) - n), n)
        return np.repeat(doc, n) * many + query[i], gain[i] * np.repeat(weight, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((many, k), -np.inf)                    # scores of this task so far, the smallest first
        for ids, doc, term, weight in read(batches):
            for base, end in _blocks(doc, asked[term], len(ids), max(1, CELLS // max(1, many))):
                a, b = np.searchsorted(doc, [base, end])
                if a == b:
                    continue
                d, t, w = doc[a:b] - base, term[a:b].astype(np.int64), weight[a:b]
                size = (end - base) * many
                cell, part = parts(follow, d, t, w)
                score = np.bincount(cell, part, size).astype(np.float64, copy=False)       # no cell: integers
                able = score.reshape(-1, many) > 0
                able &= score.reshape(-1, many) + rest + SLACK >= np.maximum(floor, best[:, 0])
                cell, part = parts(look_up, d, t, w)
                own = able.reshape(-1)[cell]
                score = (score + np.bincount(cell[own], part[own], size)).reshape(-1, many)
                text, query = np.nonzero(able & (score >= np.maximum(floor, best[:, 0] - tie)))
                value = score[text, query]
                order = np.lexsort((text, -value, query))
                text, query, value = text[order], query[order], value[order]
                new = np.append(True, (query[1:] != query[:-1]))[: len(query)]
                rank = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
                top = rank < k
                for q in np.unique(query[top]).tolist():
                    best[q] = np.sort(np.append(best[q], value[top & (query == q)]))[-k:]
                equal = new | np.append(True, value[1:] != value[:-1])[: len(query)]
                place = np.arange(len(query)) - np.maximum.accumulate(np.where(equal, np.arange(len(query)), 0))
                out = (place < k) & (value >= best[query, 0] - tie)
                yield pa.RecordBatch.from_arrays([pa.array(query[out], pa.int32()), ids.take(pa.array(text[out] + base)), pa.array(value[out])],
                                                 ["query_no", "id", "score"])
    return run


def _best(index: SearchIndex, split: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score`` of the texts that may be among the ``k`` best of a block of queries."""
    spark = split.sparkSession
    rows = split.select("query_id", "term", "gain", "only_look_up", "rest", "floor").collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    last = {r["query_id"]: r for r in rows}
    queries = {q: i for i, q in enumerate(last)}
    lists = [_lists([r for r in rows if r["only_look_up"] == x], terms, queries) for x in (False, True)]
    bounds = [np.array([r[c] for r in last.values()], np.float64) for c in ("rest", "floor")]
    out = f"query_no int, id {index.postings.schema['id'].dataType.simpleString()}, score double"
    postings = index.postings if index.texts is None else index.loose
    found = []
    if index.texts is not None:
        found.append(index.texts.select("id", "len", "terms", "tfs").mapInArrow(_scorer(_texts_of(list(terms), index.rule), *lists, *bounds, k), out))
    if postings is not None:
        numbered = spark.createDataFrame(list(terms.items()), "term string, term_no int")
        hits = postings.join(F.broadcast(numbered), "term").select("id", "term_no", "weight")
        found.append(hits.repartition("id").sortWithinPartitions("id", "term_no").mapInArrow(_scorer(_whole_texts, *lists, *bounds, k), out))
    names = spark.createDataFrame([(i, q) for q, i in queries.items()], f"query_no int, query_id {split.schema['query_id'].dataType.simpleString()}")
    return reduce(DataFrame.unionByName, found).join(F.broadcast(names), "query_no").select("query_id", "id", "score")


def search(index: SearchIndex, queries: DataFrame, k: int = 10, query_col: str = "query") -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best texts of each query
    (``query_id``, ``query``) by BM25, of equal scores the smaller id first.
    Texts without any of its terms are no results."""
    wanted = stage_table(query_terms(index, queries, query_col))
    blocks = max(1, -(-wanted.select("query_id").distinct().count() // QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    some = [wanted.filter(block == b) for b in range(blocks)]
    scores = reduce(DataFrame.unionByName, [_best(index, split_terms(w, thresholds(index, w, k)), k) for w in some])
    return _ranked(scores, k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.col("key").alias("score"))
