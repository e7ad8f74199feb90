"""Keep or drop rows of a table by (id, hash of the text), for filtering stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import stage

ID, KEY = "__keep_id", "__keep_key"


def row_key(text):
    """Tells rows with one id apart; null text counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _match(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame):
    return docs[id_col].cast("long").eqNullSafe(keys[ID]) & (row_key(docs[text_col]) == keys[KEY])


def _named(keys: DataFrame) -> DataFrame:
    a, b = keys.columns
    return stage(keys.select(F.col(a).alias(ID), F.col(b).alias(KEY)))      # Catalyst knows its size


def keep_one(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (id, key) is in ``keys`` (two columns, distinct;
    a null id matches null), columns unchanged. Of several rows with one (id,
    key) one stays, the least in the order of a hash of all columns."""
    keys = _named(keys)
    kept = docs.join(keys, _match(docs, id_col, text_col, keys), "left_semi")
    many = stage(docs.groupBy(docs[id_col].cast("long").alias(ID), row_key(docs[text_col]).alias(KEY)).count()
                 .filter("count > 1").select(ID, KEY))
    if many.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twice = kept.join(many, _match(kept, id_col, text_col, many), "left_semi")
    # maps have no hash: their text stands for them
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    first = (twice.groupBy(twice[id_col].cast("long").alias(ID), row_key(twice[text_col]).alias(KEY))
             .agg(F.min_by(row, F.xxhash64(F.struct(*parts))).alias("row")).select("row.*"))
    return kept.join(many, _match(kept, id_col, text_col, many), "left_anti").unionByName(first)


def drop_rows(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (id, key) is not in ``keys`` (null matches null)."""
    keys = _named(keys)
    return docs.join(keys, _match(docs, id_col, text_col, keys), "left_anti")
