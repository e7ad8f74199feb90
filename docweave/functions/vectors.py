"""Vector column functions: dot product, cosine distance, and the
deterministic offline hashing embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

EMBED_DIM = 64
# words of the hashing embedder: letter runs and digit runs
EMBED_TOKEN_PATTERN = r"\p{L}+|\p{N}+"


def dot(a, b) -> Column:
    """Sum of element products, in double, left to right."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _clamped(dot_ab: Column, den: Column) -> Column:
    # |1 - a.b/den| clamped to [0, 2]; a zero vector has no direction: the
    # ratio is undefined and the clamp turns it into 0 (most similar)
    return F.when(den == 0, F.lit(0.0)).otherwise(
        F.least(F.abs(F.lit(1.0) - dot_ab / den), F.lit(2.0)))


def cosine_distance(a, b) -> Column:
    """Cosine distance in [0, 2]; 0 when either vector is zero."""
    return _clamped(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def cosine_from_norms(dot_ab, sq_a, sq_b) -> Column:
    """Same value as ``cosine_distance`` given a.b, |a|^2 and |b|^2."""
    return _clamped(_c(dot_ab), F.sqrt(_c(sq_a) * _c(sq_b)))


def token_buckets(text, dim: int = EMBED_DIM) -> Column:
    """ARRAY<INT>: bucket of each word = first 32 bits of md5(word) mod dim."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(EMBED_TOKEN_PATTERN), 0)
    if dim <= 256 and dim & (dim - 1) == 0:
        # dim divides 256: the value mod dim only depends on hex digits 7-8
        # of the md5 prefix; md5 runs once per word (lambdas get no
        # common-subexpression elimination, so the digits are bound first)
        digits = F.transform(words, lambda w: F.substring(F.md5(w), 7, 2))
        return F.transform(digits, lambda h: F.pmod(F.conv(h, 16, 10).cast("int"), F.lit(dim)))
    return F.transform(words, lambda w: F.pmod(
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


def hash_embed(text, dim: int = EMBED_DIM) -> Column:
    """ARRAY<FLOAT> of ``dim`` word-bucket counts (a bag of hashed words).
    Deterministic and offline; equal in any engine with md5. Words are hashed
    JVM-side; the buckets of a whole Arrow batch are counted in one step."""
    @F.arrow_udf("array<float>")
    def counts(buckets: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cell = np.repeat(np.arange(len(buckets)) * dim, size) + buckets.flatten().to_numpy(zero_copy_only=False)
        total = np.bincount(cell.astype(np.int64), minlength=len(buckets) * dim).astype(np.float32)
        ends = np.arange(len(buckets) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(total), mask=buckets.is_null())

    return counts(token_buckets(text, dim))


def udf_embedder(embed_fn, dim: int | None = None):
    """Wrap a user ``embed_fn(list[str]) -> list[list[float]]`` (e.g. a
    service client) as an Arrow-batched pandas UDF: one call per batch."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def _embed(s: pd.Series) -> pd.Series:
        vals = s.fillna("").tolist()
        out = embed_fn(vals) if vals else []
        return pd.Series([list(map(float, v)) for v in out], dtype="object")

    return lambda col: _embed(_c(col))
