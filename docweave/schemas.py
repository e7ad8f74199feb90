"""Explicit schemas of the data model (no inference anywhere)."""

from pyspark.sql import types as T

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CAPTURED_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("depth", T.IntegerType()),
])

LINK = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("link", T.StringType()),
])

CORPUS = T.StructType([
    T.StructField("fname", T.StringType()),
    T.StructField("text", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("n_tokens", T.IntegerType()),
])

PAGE_MAP = T.StructType([
    T.StructField("sourcefile", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("page_off", T.LongType()),
    T.StructField("text", T.StringType()),
])

# Output of the section splitter (one row per section of one file).
SECTION_SPAN = T.StructType([
    T.StructField("sourcefile", T.StringType()),
    T.StructField("section_no", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("content", T.StringType()),
])

# The keyed search index: ``id`` is the key, the other three plain
# fields are filterable and facetable, ``content`` is searchable.
SECTION = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sourcepage", T.StringType()),
    T.StructField("sourcefile", T.StringType()),
])

LAYOUT_CELL = T.StructType([
    T.StructField("row_index", T.IntegerType()),
    T.StructField("column_index", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("row_span", T.IntegerType()),
    T.StructField("column_span", T.IntegerType()),
    T.StructField("content", T.StringType()),
])

SPAN = T.StructType([
    T.StructField("offset", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
])

LAYOUT_TABLE = T.StructType([
    T.StructField("row_count", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()),   # first bounding region, 1-based
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("cells", T.ArrayType(LAYOUT_CELL)),
])

LAYOUT_PAGE = T.StructType([
    T.StructField("page_num", T.IntegerType()),      # 0-based
    T.StructField("offset", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
])

LAYOUT_RESULT = T.StructType([
    T.StructField("sourcefile", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("pages", T.ArrayType(LAYOUT_PAGE)),
    T.StructField("tables", T.ArrayType(LAYOUT_TABLE)),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

QUESTION_BODY = T.StructType([T.StructField("query", T.StringType())])

PAGE_BLOB = T.StructType([
    T.StructField("blob_name", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("sourcefile", T.StringType()),     # key of the store
])
