"""Nearest chunks per question and budgeted context assembly.

Vectors are stored by cluster and scored only where a wanted row can be (see
``vector_index``); what moves for a candidate is its id, its tokens and its
distance. One exchange by question and a window give the rows kept, at most
``max_len // per_chunk`` for a question (each costs at least ``per_chunk``),
and only these are joined with their text. Questions go in batches whose
matrices have a bounded size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import stage_table
from . import vector_index as VI

MAX_CONTEXT_TOKENS = 1800   # context budget
PER_CHUNK_OVERHEAD = 4      # tokens added per chunk
SEPARATOR = "\n\n###\n\n"
MAX_BROADCAST_QUESTIONS = 20000


def embed(df: DataFrame, text_col: str = "text", out: str = "embedding",
          embedder=None, dim: int = V.EMBED_DIM) -> DataFrame:
    """Add an embedding column; default is the offline hashing embedder,
    ``embedder`` is any ``Column -> Column`` (see ``udf_embedder``)."""
    fn = embedder or (lambda c: V.hash_embed(c, dim))
    return df.withColumn(out, fn(F.col(text_col)))


MAX_BROADCAST_BYTES = 64 << 20    # question vectors, and distances to the centers, of a batch
MAX_HELD_ROWS = 4_000_000         # candidates that a task can hold for a batch (24 bytes and the ids each)


def _question_batches(questions: DataFrame, max_broadcast: int, index: VI.VectorIndex, need: VI.Need):
    """Split the questions so that a batch has at most ``max_broadcast`` rows,
    its matrices ``MAX_BROADCAST_BYTES`` and a task's candidates
    ``MAX_HELD_ROWS`` (row count and largest dimension come from one small job)."""
    st = questions.agg(F.count("*").alias("n"),
                       F.coalesce(F.max(F.size("q_embedding")), F.lit(0)).alias("dim")).first()
    n, width = st["n"], max(int(st["dim"]), len(index.centers), 1)
    rows = need.cap or MAX_HELD_ROWS
    per_batch = max(1, min(max_broadcast, MAX_BROADCAST_BYTES // (width * 8), MAX_HELD_ROWS // rows))
    if n <= per_batch:
        return [questions]
    k = -(-n * 6 // (per_batch * 5))       # 20% slack: batches are assigned by hash
    tagged = questions.withColumn("_qb", F.pmod(F.xxhash64("question_id"), F.lit(k)))
    return [tagged.filter(F.col("_qb") == i).drop("_qb") for i in range(k)]


def chunk_index(chunks: DataFrame, id_cols=("chunk_id",), payload=None, cost_col: str | None = "n_tokens") -> VI.VectorIndex:
    """Index of a chunk table to pass as ``index=`` when questions come in
    many calls. ``payload``: columns kept with the vectors (ids and cost)."""
    own = list(payload) if payload is not None else [*id_cols, *([cost_col] if cost_col else [])]
    return VI.build_index(chunks, own, "embedding", cost_col)


def score(index: VI.VectorIndex, questions: DataFrame, need: VI.Need, id_cols, max_broadcast: int = MAX_BROADCAST_QUESTIONS,
          block_cells: int = VI.BLOCK_CELLS) -> DataFrame:
    """(payload..., question_id, distance): every row that ``need`` can take,
    for questions(question_id, q_embedding). A missing or zero vector, on
    either side, has no distance to anything."""
    field = questions.schema["question_id"]
    out = []
    for qb in _question_batches(questions.select("question_id", "q_embedding"), max_broadcast, index, need):
        rows = [r for r in qb.collect() if r["q_embedding"] is not None and any(r["q_embedding"])]      # bounded
        if rows:
            matrix = np.array([np.asarray(r["q_embedding"], dtype=np.float64) for r in rows])
            out.append(VI.search(index, [r["question_id"] for r in rows], matrix, need, list(id_cols), field, block_cells))
    return reduce(DataFrame.unionByName, out) if out else VI.search(index, [], np.zeros((0, 1)), need, list(id_cols), field)


def nearest(chunks: DataFrame, questions: DataFrame, k: int = 5, id_cols=("chunk_id",), index: VI.VectorIndex | None = None, **kw) -> DataFrame:
    """Top-k chunks per question by cosine distance (ties by chunk id)."""
    index = index or chunk_index(chunks, id_cols, [c for c in chunks.columns if c != "embedding"], None)
    need = VI.Need(cap=k)
    return VI.best_rows(score(index, questions, need, id_cols, **kw), ["question_id"], list(id_cols), need, None)


def context_rows(chunks: DataFrame | None, questions: DataFrame, max_len: int = MAX_CONTEXT_TOKENS,
                 per_chunk: int = PER_CHUNK_OVERHEAD, id_cols=("chunk_id",), index: VI.VectorIndex | None = None, **kw) -> DataFrame:
    """Ids of the chunks kept per question: ascending distance, stopping at
    the first one that would push ``sum(n_tokens + per_chunk)`` over
    ``max_len``; with ``rank``, ``distance`` and ``used_tokens``."""
    index = index or chunk_index(chunks, id_cols)
    need = VI.Need(cap=max_len // per_chunk if per_chunk > 0 else None, budget=max_len, per_row=per_chunk)
    rows = VI.best_rows(score(index, questions, need, id_cols, **kw), ["question_id"], list(id_cols), need, "n_tokens")
    # prefix property: once over, every later row is over too (costs > 0)
    return rows.withColumnRenamed("used", "used_tokens").filter(F.col("used_tokens") <= max_len).drop("before")


def build_context(chunks: DataFrame, questions: DataFrame, max_len: int = MAX_CONTEXT_TOKENS,
                  per_chunk: int = PER_CHUNK_OVERHEAD, sep: str = SEPARATOR, id_cols=("chunk_id",),
                  index: VI.VectorIndex | None = None, **kw) -> DataFrame:
    """(question_id, context, n_chunks, used_tokens): chosen chunk texts
    joined in ascending distance; '' when even the first chunk overflows.

    Without an ``index`` the chunks are written to the shared checkpoint
    folder and indexed. Only the chunks kept are joined with their text."""
    ids = list(id_cols)
    if index is None:
        chunks = stage_table(chunks.select(*ids, "text", "n_tokens", "embedding"))
        index = chunk_index(chunks, ids)
    rows = context_rows(None, questions, max_len, per_chunk, ids, index, **kw)
    kept = rows.select("question_id", *ids, "rank", "used_tokens").join(chunks.select(*ids, "text"), ids)
    agg = kept.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"),       # texts within one budget
        F.max("used_tokens").alias("used_tokens"))
    ctx = agg.select("question_id",
                     F.array_join(F.transform("_c", lambda x: x["text"]), sep).alias("context"),
                     F.size("_c").cast("long").alias("n_chunks"),
                     F.col("used_tokens").cast("long").alias("used_tokens"))
    # questions with nothing under budget still get an (empty) context
    q = questions.select("question_id")
    return (q.join(ctx, "question_id", "left")
             .select("question_id", F.coalesce("context", F.lit("")).alias("context"),
                     F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
                     F.coalesce("used_tokens", F.lit(0)).cast("long").alias("used_tokens")))
