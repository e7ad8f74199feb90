"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
computed over whole tables. Column names and types match the DuckDB
oracles in ``docweave.plans.oracle``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import chunking as CH
from ..operators import retrieval as R
from ..session import ensure_checkpoint_dir, stage_table
from ..sources import tables as S

CHUNK_IDS = ("doc_id", "chunk_no")      # a chunk's key
FEW_LABELS = 500_000                    # rows of three numbers (some 40 MB) that go to every task, so that no text moves for them


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---------------------------------------------------------------- corpus

def corpus_df(spark, sf_dir) -> DataFrame:
    c = CH.corpus(S.doc_corpus_input(spark, sf_dir))
    return CH.with_token_count(c)


def chunk_df(spark, sf_dir, max_tokens: int = CH.MAX_TOKENS) -> DataFrame:
    return CH.chunks(corpus_df(spark, sf_dir), "doc_id", "text", max_tokens)


def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.documents(spark, sf_dir)
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    TX.token_count("text").cast("long").alias("n_tokens"))


def q_clean_text(spark, sf_dir) -> DataFrame:
    d = S.documents(spark, sf_dir)
    return d.select("doc_id", TX.clean_text("text").alias("text"))


def q_corpus(spark, sf_dir) -> DataFrame:
    c = corpus_df(spark, sf_dir)
    return c.select("doc_id", "fname", "text", *_long("n_tokens"))


def q_chunks(spark, sf_dir) -> DataFrame:
    return chunk_df(spark, sf_dir).select("doc_id", *_long("chunk_no"), "text", *_long("n_tokens"))


def q_sentence_pack(spark, sf_dir) -> DataFrame:
    """Chunks of at most 200 tokens (no text lost)."""
    return chunk_df(spark, sf_dir, 200).select(
        "doc_id", *_long("chunk_no"), "text", *_long("n_tokens"))


def q_token_histogram(spark, sf_dir) -> DataFrame:
    return CH.token_histogram(corpus_df(spark, sf_dir), "n_tokens", 10)


# ------------------------------------------------------------- retrieval

def embedded_chunks(spark, sf_dir) -> DataFrame:
    return R.embed(chunk_df(spark, sf_dir), "text", "embedding")


def embedded_questions(spark, sf_dir) -> DataFrame:
    q = S.questions(spark, sf_dir)
    return R.embed(q, "question", "q_embedding")


def q_hash_embed(spark, sf_dir) -> DataFrame:
    c = chunk_df(spark, sf_dir)
    e = c.select("doc_id", "chunk_no", F.posexplode(V.hash_embed("text")).alias("bucket", "count"))
    return e.filter(F.col("count") > 0).select(
        "doc_id", *_long("chunk_no", "bucket", "count"))


def q_context(spark, sf_dir) -> DataFrame:
    return R.build_context(embedded_chunks(spark, sf_dir), embedded_questions(spark, sf_dir).select("question_id", "q_embedding"),
                           id_cols=CHUNK_IDS)


def q_nearest(spark, sf_dir) -> DataFrame:
    vec = S.vectors(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    q = embedded_questions(spark, sf_dir).select("question_id", "q_embedding")
    n = R.nearest(vec, q, k=5)
    return n.select("question_id", F.col("rank").cast("long").alias("rank"),
                    F.col("chunk_id").alias("vec_id"), F.col("label").cast("long").alias("label"),
                    F.round("distance", 6).alias("distance"))


QUERIES = {
    "token_counts": q_token_counts,
    "clean_text": q_clean_text,
    "corpus": q_corpus,
    "chunks": q_chunks,
    "sentence_pack": q_sentence_pack,
    "token_histogram": q_token_histogram,
    "hash_embed": q_hash_embed,
    "context": q_context,
    "nearest": q_nearest,
}


# -------------------------------------------------------------------- web
from ..operators import frontier as FR  # noqa: E402
from ..operators import web as W  # noqa: E402


def q_page_key(spark, sf_dir) -> DataFrame:
    p = W.with_site(S.pages(spark, sf_dir))
    return p.select("page_id", "url", "netloc", "page_key")


def q_links(spark, sf_dir) -> DataFrame:
    return W.page_links(S.pages(spark, sf_dir))


def q_links_legacy(spark, sf_dir) -> DataFrame:
    return W.page_links_legacy(S.pages(spark, sf_dir))


def q_page_dedup(spark, sf_dir) -> DataFrame:
    d = W.dedup_pages(S.pages(spark, sf_dir), cols=("page_id", "url"))
    return d.select("netloc", "page_key", F.col("n_versions").cast("long").alias("n_versions"),
                    "page_id", "url")


def q_simplify_html(spark, sf_dir) -> DataFrame:
    return W.simplify_pages(S.pages(spark, sf_dir))


def q_page_text(spark, sf_dir) -> DataFrame:
    return W.page_texts(S.pages(spark, sf_dir))


def q_page_text_plain(spark, sf_dir) -> DataFrame:
    return W.page_texts_plain(S.pages(spark, sf_dir))


def q_page_parts(spark, sf_dir) -> DataFrame:
    return W.page_parts(S.pages(spark, sf_dir))


def q_tag_audit(spark, sf_dir) -> DataFrame:
    return W.tag_audit(S.pages(spark, sf_dir))


def q_frontier(spark, sf_dir) -> DataFrame:
    pages = S.pages(spark, sf_dir)
    links = W.page_links(pages)
    f = FR.crawl_frontier(pages, links, max_depth=2)
    return f.select("url", F.col("depth").cast("long").alias("depth"))


QUERIES.update({
    "page_key": q_page_key,
    "links": q_links,
    "links_legacy": q_links_legacy,
    "page_dedup": q_page_dedup,
    "simplify_html": q_simplify_html,
    "page_text": q_page_text,
    "page_text_plain": q_page_text_plain,
    "page_parts": q_page_parts,
    "tag_audit": q_tag_audit,
    "frontier": q_frontier,
})


# --------------------------------------------------------------- sections
from ..functions import urls as U  # noqa: E402
from ..operators import index as IX  # noqa: E402
from ..operators import search as SR  # noqa: E402
from ..sinks import site_store as SS  # noqa: E402
from ..operators import sections as SE  # noqa: E402


def _sec_out(df: DataFrame, content: bool = True) -> DataFrame:
    cols = ["id"] + (["content"] if content else []) + ["category", "sourcepage", "sourcefile"]
    return df.select(*[c for c in cols if c in df.columns], *_long("section_no", "start", "end", "page_num"))


def doc_section_input(spark, sf_dir) -> DataFrame:
    """Documents as text files, with a category tag from the labels
    (``quality=<0|1>``; NULL when unlabelled) and the toxic flag."""
    d = S.doc_files(spark, sf_dir).filter(F.col("text").isNotNull())
    lab = S.labels(spark, sf_dir)
    if lab.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        lab = F.broadcast(lab)
    return (d.join(lab, "doc_id", "left")
             .select("sourcefile", "text",
                     F.concat(F.lit("quality="), F.col("quality").cast("string")).alias("category"),
                     "toxic"))


def doc_sections(spark, sf_dir) -> DataFrame:
    return SE.sections(doc_section_input(spark, sf_dir), category="category")


def q_sections(spark, sf_dir) -> DataFrame:
    return _sec_out(doc_sections(spark, sf_dir))


def conv_page_map(spark, sf_dir) -> DataFrame:
    return SE.page_map(S.conversation_pages(spark, sf_dir))


def q_page_map(spark, sf_dir) -> DataFrame:
    pm = conv_page_map(spark, sf_dir)
    return pm.select("sourcefile", *_long("page_num", "page_off"), "text")


def q_section_pages(spark, sf_dir) -> DataFrame:
    s = SE.sections_of_pages(S.conversation_pages(spark, sf_dir))
    return s.select("id", "content", "sourcepage", "sourcefile",
                    *_long("section_no", "start", "end", "page_num"))


def all_pages(spark, sf_dir) -> DataFrame:
    """Pages of every file: conversations (paged) and documents (one page)."""
    conv = S.conversation_pages(spark, sf_dir)
    docs = S.doc_files(spark, sf_dir).select("sourcefile", F.lit(0).alias("page_num"), "text")
    return conv.unionByName(docs)


def q_blob_names(spark, sf_dir) -> DataFrame:
    p = all_pages(spark, sf_dir)
    return p.select("sourcefile", *_long("page_num"), U.blob_name("sourcefile", "page_num").alias("blob_name"))


def blobs_df(spark, sf_dir) -> DataFrame:
    return IX.page_blobs(all_pages(spark, sf_dir))


def _stored_blobs(spark, sf_dir) -> str:
    """The page blobs of all files, uploaded to a new store."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/blobs-{uuid.uuid4().hex}"
    SS.upload_blobs(all_pages(spark, sf_dir), path, buckets=16)
    return path


def _blob_rows(spark, path) -> DataFrame:
    return SS.read_blobs(spark, path).select("blob_name", "sourcefile", *_long("page_num"), "text")


def q_page_blobs(spark, sf_dir) -> DataFrame:
    """Page blobs, uploaded to the store and read back."""
    return _blob_rows(spark, _stored_blobs(spark, sf_dir))


def q_remove_pages(spark, sf_dir) -> DataFrame:
    """The stored page blobs after those of the conversations that carry a
    system turn were removed from the store."""
    conv = S.table(spark, sf_dir, "conversations").select("conv_id", "role")
    gone = conv.filter(F.col("role") == "system").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")).alias("sourcefile"))
    path = _stored_blobs(spark, sf_dir)
    SS.remove_blobs(spark, path, gone)
    return _blob_rows(spark, path)


def section_index(spark, sf_dir) -> DataFrame:
    """Index after two loads: every document untagged, then the labelled
    ones re-sent with their category (upsert by id)."""
    # written once to the shared checkpoint folder: both loads read it
    # instead of running the section splitter twice
    secs = stage_table(doc_sections(spark, sf_dir), small=True)
    existing = secs.withColumn("category", F.lit(None).cast("string"))
    incoming = secs.filter(F.col("category").isNotNull())
    return IX.upsert(existing, incoming)


def q_index_upsert(spark, sf_dir) -> DataFrame:
    return section_index(spark, sf_dir)


def q_index_delete(spark, sf_dir) -> DataFrame:
    """Remove the sections of documents labelled toxic."""
    lab = S.labels(spark, sf_dir).filter(F.col("toxic") == 1)
    files = lab.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("sourcefile"))
    return IX.delete(section_index(spark, sf_dir), files)


def q_index_lookup(spark, sf_dir) -> DataFrame:
    return IX.lookup(section_index(spark, sf_dir))


def q_index_facets(spark, sf_dir) -> DataFrame:
    return IX.facets(section_index(spark, sf_dir))


def q_content_postings(spark, sf_dir) -> DataFrame:
    return IX.postings(section_index(spark, sf_dir)).select("term", "id", F.col("tf").cast("long"))


def q_content_search(spark, sf_dir) -> DataFrame:
    """The ten best sections for every benchmark text, by BM25."""
    index = SR.build(section_index(spark, sf_dir))
    q = S.questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))
    return SR.search(index, q, 10).select(F.col("query_id").alias("question_id"), "rank", "id", F.round("score", 6).alias("score"))


QUERIES.update({
    "content_search": q_content_search,
    "sections": q_sections,
    "page_map": q_page_map,
    "section_pages": q_section_pages,
    "blob_names": q_blob_names,
    "page_blobs": q_page_blobs,
    "remove_pages": q_remove_pages,
    "index_upsert": q_index_upsert,
    "index_delete": q_index_delete,
    "index_lookup": q_index_lookup,
    "index_facets": q_index_facets,
    "content_postings": q_content_postings,
})


# ---------------------------------------------------------------- prompts
from ..operators import prompts as PR  # noqa: E402
from ..sources import files as FI  # noqa: E402


def contexts_with_questions(spark, sf_dir) -> DataFrame:
    ctx = q_context(spark, sf_dir)
    return ctx.join(S.questions(spark, sf_dir), "question_id")


def q_chat_prompt(spark, sf_dir) -> DataFrame:
    p = PR.chat_prompt(contexts_with_questions(spark, sf_dir))
    return p.select("question_id",
                    F.col("messages")[0]["role"].alias("system_role"),
                    F.col("messages")[0]["content"].alias("system_prompt"),
                    F.col("messages")[1]["role"].alias("user_role"),
                    F.col("messages")[1]["content"].alias("user_prompt"),
                    F.col("settings.temperature").alias("temperature"),
                    F.col("settings.max_tokens").cast("long").alias("max_tokens"),
                    F.col("settings.top_p").alias("top_p"))


def q_completion_prompt(spark, sf_dir) -> DataFrame:
    p = PR.completion_prompt(contexts_with_questions(spark, sf_dir))
    return p.select("question_id", "prompt",
                    F.col("settings.temperature").alias("temperature"),
                    F.col("settings.max_tokens").cast("long").alias("max_tokens"),
                    F.col("settings.top_p").alias("top_p"))


def q_questions_json(spark, sf_dir) -> DataFrame:
    """Benchmark items sent as request bodies ``{"query": ...}`` and parsed back."""
    b = S.table(spark, sf_dir, "benchmark").select("item_id", "text")
    bodies = b.select("item_id", F.to_json(F.struct(F.col("text").alias("query"))).alias("body"))
    q = FI.parse_question_bodies(bodies, "body")
    return q.select(F.col("item_id").alias("question_id"), "question")


def q_export_vectors(spark, sf_dir) -> DataFrame:
    """Chunk table in the CSV-compatible form: vector as a JSON list."""
    e = embedded_chunks(spark, sf_dir)
    return FI.vectors_to_text(e, "embedding", "embeddings").select(
        "doc_id", *_long("chunk_no"), "text", *_long("n_tokens"), "embeddings")


def q_parse_vectors(spark, sf_dir) -> DataFrame:
    """Vector strings of the exported chunk table parsed back to arrays."""
    t = FI.vectors_to_text(embedded_chunks(spark, sf_dir), "embedding", "embeddings")
    p = FI.parse_vectors(t, "embeddings", "vec")
    return p.select("doc_id", *_long("chunk_no"), F.size("vec").cast("long").alias("dim"),
                    F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x).alias("total"))


QUERIES.update({
    "chat_prompt": q_chat_prompt,
    "completion_prompt": q_completion_prompt,
    "questions_json": q_questions_json,
    "export_vectors": q_export_vectors,
    "parse_vectors": q_parse_vectors,
})


# ------------------------------------------------------------- tree lines
from ..operators import html_tree as HT  # noqa: E402


def q_tag_lines(spark, sf_dir) -> DataFrame:
    """One text line per text-bearing element of each simplified page
    (tree walk in document order; the oracle rebuilds the tree with a stack fold)."""
    simp = W.simplify_pages(S.pages(spark, sf_dir))
    return HT.tag_lines(simp, "html", "page_id")


QUERIES["tag_lines"] = q_tag_lines


def q_csv_roundtrip(spark, sf_dir) -> DataFrame:
    """Corpus rows written as CSV (header, quoted multi-line fields) to a
    new folder under the shared checkpoint folder, read back as (title, text)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/corpus-csv-{uuid.uuid4().hex}"
    FI.write_corpus_csv(corpus_df(spark, sf_dir).select("fname", "text"), path)
    return FI.read_corpus_csv(spark, path)


QUERIES["csv_roundtrip"] = q_csv_roundtrip


# ----------------------------------------------------------------- layout
from ..operators import layout as LA  # noqa: E402


def order_layout(spark, sf_dir) -> DataFrame:
    """A layout result for each order: one page with a sentence, a table of
    the order's lines (header row, then a row for each line number) and an
    end mark."""
    li = S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(F.col("l_linenumber").cast("int").alias("r"), F.col("l_partkey").alias("p"),
                               F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q")).alias("x"))
    o = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def cell(kind, r, c, content):
        return F.struct(kind.alias("kind"), r.cast("int").alias("row_index"), F.lit(c).alias("column_index"), F.lit(1).alias("row_span"),
                        F.lit(1).alias("column_span"), content.alias("content"))
    head = F.array(cell(F.lit("columnHeader"), F.lit(0), 0, F.lit("Part <no> & name")), cell(F.lit("columnHeader"), F.lit(0), 1, F.lit("Qty")))
    body = F.flatten(F.transform("x", lambda x: F.array(
        cell(F.lit("content"), x["r"], 1, x["q"].cast("string")), cell(F.lit("content"), x["r"], 0, x["p"].cast("string")))))
    intro = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(": "))
    lines = F.array_join(F.transform("x", lambda x: F.concat_ws(" ", x["p"].cast("string"), x["q"].cast("string"))), "; ")
    o = o.select("l_orderkey", intro.alias("intro"), lines.alias("lines"), F.concat(head, body).alias("cells"),
                 (F.array_max(F.transform("x", lambda x: x["r"])) + 1).alias("row_count"))
    content = F.concat("intro", "lines", F.lit(" End."))
    table = F.struct(F.lit(1).alias("page_number"), F.col("row_count"), F.col("cells"), F.array(F.struct(
        F.length("intro").alias("offset"), F.length("lines").alias("length"))).alias("spans"))
    return o.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("sourcefile"),
                    content.alias("content"), F.array(table).alias("tables"),
                    F.array(F.struct(F.lit(0).alias("page_num"), F.lit(0).alias("offset"), F.length(content).alias("length"))).alias("pages"))


def q_layout_cells(spark, sf_dir) -> DataFrame:
    c = LA.layout_cells(order_layout(spark, sf_dir))
    return c.select("sourcefile", *_long("table_id", "row_index", "column_index"), "kind", "content")


def q_table_html(spark, sf_dir) -> DataFrame:
    t = order_layout(spark, sf_dir).select("sourcefile", F.explode("tables").alias("t"))
    return t.select("sourcefile", LA.table_html(F.col("t.row_count"), F.col("t.cells")).alias("html"))


def q_layout_overlay(spark, sf_dir) -> DataFrame:
    return LA.overlay_pages(order_layout(spark, sf_dir)).select("sourcefile", *_long("page_num"), "text")


def q_route_pages(spark, sf_dir) -> DataFrame:
    """Pages routed by a content type that their URL stands for."""
    kind = (F.when(F.col("url").contains("/de/"), "application/pdf").when(F.col("url").contains("/es/"), "image/png")
            .otherwise("text/html; charset=utf-8"))
    return W.route_pages(S.pages(spark, sf_dir).select("page_id", kind.alias("content_type"))).select("page_id", "content_type", "route")


def _graph(spark, sf_dir):
    """Seeds and links of the supplier-part graph of all lines; seeds are the
    suppliers whose account is below zero."""
    li = S.table(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = li.select(s.alias("src"), p.alias("dst")).union(li.select(p, s)).distinct()
    seeds = (S.table(spark, sf_dir, "supplier").filter("s_acctbal < 0")
             .select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("url")))
    return seeds, edges


def q_frontier_graph(spark, sf_dir) -> DataFrame:
    """Breadth-first frontier to depth 4 over the supplier-part graph."""
    return FR.expand(*_graph(spark, sf_dir), 4).select("url", *_long("depth"))


def q_frontier_resume(spark, sf_dir) -> DataFrame:
    """A stored crawl of the supplier-part graph to depth 2, opened again and extended to depth 4."""
    state = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}"
    seeds, edges = _graph(spark, sf_dir)
    FR.expand(seeds, edges, 2, state=state)
    return FR.expand(seeds.limit(0), edges, 4, state=state).select("url", *_long("depth"))


QUERIES.update({
    "layout_cells": q_layout_cells,
    "table_html": q_table_html,
    "layout_overlay": q_layout_overlay,
    "route_pages": q_route_pages,
    "frontier_graph": q_frontier_graph,
    "frontier_resume": q_frontier_resume,
})


# --------------------------------------------------- preparation job, answers
from ..sinks import index_store as IS  # noqa: E402
from ..sinks import prepare as PP  # noqa: E402


def _prepared(spark, sf_dir):
    """Folders of an index and a blob store to which all conversations were added, and the upload report."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/prepared-{uuid.uuid4().hex}"
    report = PP.prepare_documents(spark, "add", f"{root}/index", f"{root}/blobs", pages=S.conversation_pages(spark, sf_dir),
                                  category="chat", buckets=16)
    return f"{root}/index", f"{root}/blobs", report


def q_prepare_add(spark, sf_dir) -> DataFrame:
    """Mode "add": for every file the sections sent, and those found in the stored index."""
    return _prepared(spark, sf_dir)[2].select("sourcefile", *_long("sent", "succeeded"))


def q_prepare_remove(spark, sf_dir) -> DataFrame:
    """Mode "remove": the stored index after the conversations that carry a system turn were removed."""
    index, blobs, _ = _prepared(spark, sf_dir)
    gone = S.table(spark, sf_dir, "conversations").filter("role = 'system'").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")).alias("sourcefile"))
    PP.prepare_documents(spark, "remove", index, blobs, files=gone, buckets=16)
    return IS.read(spark, index, 16)


def _echo(prompts: list[str]) -> list[str]:
    """Stands in for a completion service: repeats the question, and refuses long ones."""
    questions = [p[: -len("\nAnswer:")].rsplit("Question: ", 1)[1] for p in prompts]
    if any(len(q) > 120 for q in questions):
        raise ValueError("too long")
    return questions


def q_answers(spark, sf_dir) -> DataFrame:
    """Answers to all questions, written to the answer sink and read back; a prompt that fails is the only one without an answer."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    SS.write_answers(PR.answer(PR.completion_prompt(contexts_with_questions(spark, sf_dir)), _echo), path)
    return spark.read.parquet(path).select("question_id", "answer", "answer_error")


QUERIES.update({
    "prepare_add": q_prepare_add,
    "prepare_remove": q_prepare_remove,
    "answers": q_answers,
})
