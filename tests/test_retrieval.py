from docweave.operators import prompts as PR
from docweave.operators import retrieval as R

CHUNKS = [(1, "t1", 10, [1.0, 0.0]), (2, "t2", 10, [1.0, 0.0]), (3, "t3", 5, [0.0, 1.0]), (4, "t4", 1, [0.0, 0.0])]


def frames(spark):
    c = spark.createDataFrame(CHUNKS, "chunk_id long, text string, n_tokens int, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "question_id long, q_embedding array<float>")
    return c, q


def ctx(spark, max_len):
    c, q = frames(spark)
    return {r["question_id"]: (r["context"], r["used_tokens"])
            for r in R.build_context(c, q, max_len=max_len).collect()}


def test_ties_by_id_and_budget_stop(spark):
    assert ctx(spark, 30)[7] == ("t1\n\n###\n\nt2", 28)


def test_budget_met_exactly(spark):
    assert ctx(spark, 28)[7] == ("t1\n\n###\n\nt2", 28)


def test_first_chunk_over_budget_gives_empty_context(spark):
    assert ctx(spark, 13)[7] == ("", 0)


def test_zero_vectors_are_left_out(spark):
    # an undefined cosine is no distance: the chunk is no match, the question has none
    got = ctx(spark, 100)
    assert got[7] == ("t1\n\n###\n\nt2\n\n###\n\nt3", 37)
    assert got[8] == ("", 0)


def test_distance_values(spark):
    from pyspark.sql import functions as F
    from docweave.functions import vectors as V
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])],
                               "a array<double>, b array<double>")
    got = [round(r["d"], 12) for r in df.select(V.cosine_distance("a", "b").alias("d")).collect()]
    assert got == [2.0, 0.0, 0.0]


def test_nearest_topk(spark):
    c, q = frames(spark)
    got = [(r["question_id"], r["rank"], r["chunk_id"]) for r in
           R.nearest(c, q, k=2).orderBy("question_id", "rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 2)]


def test_question_batches_beyond_broadcast_bound(spark):
    c, q = frames(spark)
    a = sorted((r["question_id"], r["context"]) for r in R.build_context(c, q, max_len=30).collect())
    b = sorted((r["question_id"], r["context"]) for r in R.build_context(c, q, max_len=30, max_broadcast=1).collect())
    assert a == b


def test_prompts_and_answers(spark):
    df = spark.createDataFrame([(1, "Q?", "C")], "question_id long, question string, context string")
    p = PR.completion_prompt(df).first()
    assert p["prompt"].endswith("Context: C\n\n---\n\nQuestion: Q?\nAnswer:")
    assert p["settings"]["temperature"] == 0.0 and p["settings"]["max_tokens"] == 150
    m = PR.chat_prompt(df).first()
    assert m["messages"][0]["role"] == "system" and m["messages"][0]["content"].endswith("\n\nContext: C")
    assert m["messages"][1]["content"] == "Question: Q?" and m["settings"]["top_p"] == 0.8
    ok = PR.answer(PR.completion_prompt(df), lambda ps: ["  yes  " for _ in ps]).first()["answer"]
    assert ok == "yes"

    def boom(ps):
        raise RuntimeError("down")

    assert PR.answer(PR.completion_prompt(df), boom).first()["answer"] == ""
    assert PR.answer(PR.completion_prompt(df)).first()["answer"] == ""


def test_one_failing_prompt_of_eight(spark):
    df = spark.createDataFrame([(i, f"q{i}", "c") for i in range(8)], "question_id long, question string, context string").coalesce(1)

    def fn(prompts):
        if any("q3" in p for p in prompts):
            raise RuntimeError("refused")
        return [p[-12:-8] for p in prompts]
    got = {r["question_id"]: r for r in PR.answer(PR.completion_prompt(df), fn).collect()}
    assert [i for i, r in got.items() if r["answer"] == ""] == [3]
    assert got[3]["answer_error"] == "RuntimeError: refused" and got[4]["answer_error"] is None

    def chat(calls):
        return [f"{m[1]['content']}/{m[0]['role']}/{s['temperature']}" for m, s in calls]
    said = {r["question_id"]: r["answer"] for r in
            PR.answer(PR.chat_prompt(df), chat, prompt_col="messages", with_settings=True).collect()}
    assert said[5] == "Question: q5/system/0.2"


def test_question_blocks_inside_a_batch(spark):
    c, q = frames(spark)
    a = sorted((r["question_id"], r["context"]) for r in R.build_context(c, q, max_len=30).collect())
    # one question per block, all chunks in one batch
    b = sorted((r["question_id"], r["context"])
               for r in R.build_context(c.coalesce(1), q, max_len=30, block_cells=1).collect())
    assert a == b


def test_missing_embedding_is_no_match(spark):
    c = spark.createDataFrame([(1, "a", 1, [1.0, 0.0]), (2, "b", 1, None)],
                              "chunk_id long, text string, n_tokens int, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 1.0])], "question_id long, q_embedding array<float>")
    got = [(r["chunk_id"], r["distance"]) for r in R.nearest(c, q, k=2).orderBy("rank").collect()]
    assert got == [(1, 1.0)]


def test_context_equals_brute_force_on_fixture(spark):
    import os
    import numpy as np
    from docweave.plans import queries as Q
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    from pyspark.sql import functions as F
    chunks = (Q.embedded_chunks(spark, sf).withColumn("chunk_id", F.col("doc_id") * 1000 + F.col("chunk_no"))
              .select("chunk_id", "text", "n_tokens", "embedding").repartition(4))
    qs = Q.embedded_questions(spark, sf).select("question_id", "q_embedding")
    got = {r["question_id"]: r["context"] for r in R.build_context(chunks, qs, max_len=600).collect()}
    c = chunks.toPandas().sort_values("chunk_id")
    emb = np.stack([np.asarray(v, dtype=np.float64) for v in c["embedding"]])
    for r in qs.collect():
        q = np.asarray(r["q_embedding"], dtype=np.float64)
        den = np.sqrt((emb * emb).sum(1) * (q @ q))
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(den == 0, np.inf, np.minimum(np.abs(1 - emb @ q / den), 2.0))
        order = [i for i in np.lexsort((c["chunk_id"].to_numpy(), d)) if den[i] > 0]
        used, kept = 0, []
        for i in order:                                   # the reference loop
            used += int(c["n_tokens"].iloc[i]) + 4
            if used > 600:
                break
            kept.append(c["text"].iloc[i])
        assert got[r["question_id"]] == "\n\n###\n\n".join(kept)


def brute_prefix(chunks, q, max_len, cap=None):
    """Ids in ascending (distance, id) while the budget lasts; ``chunks``: (id, tokens, unit vector)."""
    d = sorted((min(abs(1 - float(v @ q)), 2.0), i, n) for i, n, v in chunks)
    out, used = [], 0
    for _, i, n in d[:cap]:
        used += n + 4
        if max_len is not None and used > max_len:
            break
        out.append(i)
    return out


def clustered_chunks(spark, n=3000, groups=30, spread=0.05, seed=0):
    import numpy as np
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 16))
    v = middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 16))
    rows = [(i, int(rng.integers(1, 60)), (v[i] * rng.uniform(0.1, 9)).tolist()) for i in range(n)]
    questions = [(100 + k, (middle[k % groups] + spread * rng.normal(size=16)).tolist()) for k in range(25)] + [(900, rng.normal(size=16).tolist())]
    df = spark.createDataFrame([(i, str(i), t, e) for i, t, e in rows], "chunk_id long, text string, n_tokens int, embedding array<double>")
    return rows, questions, df.repartition(5), spark.createDataFrame(questions, "question_id long, q_embedding array<double>")


def test_index_search_equals_brute_force(spark):
    import numpy as np
    rows, questions, df, qs = clustered_chunks(spark)
    known = [(i, n, np.array(e) / np.linalg.norm(e)) for i, n, e in rows]
    for max_len in (5, 60, 1500, 10 ** 9):
        got = {r["question_id"]: r["context"] for r in R.build_context(df, qs, max_len=max_len, sep=" ").collect()}
        for q, e in questions if max_len < 10 ** 9 else questions[:2]:
            want = brute_prefix(known, np.array(e) / np.linalg.norm(e), max_len, max_len // 4)
            assert got[q].split() == [str(i) for i in want], (max_len, q)
    near = {}
    for r in R.nearest(df, qs, k=7).collect():
        near.setdefault(r["question_id"], {})[r["rank"]] = r["chunk_id"]
    for q, e in questions:
        assert [near[q][k + 1] for k in range(7)] == brute_prefix(known, np.array(e) / np.linalg.norm(e), None, 7)


def test_clusters_that_cannot_matter_are_skipped(spark):
    import numpy as np
    from docweave.operators import vector_index as VI
    _, questions, df, qs = clustered_chunks(spark)
    index = R.chunk_index(df)
    need = VI.Need(cap=75, budget=300, per_row=4)
    q = VI.unit(np.array([e for _, e in questions[:-1]]))
    to_center, first, limit = VI.cluster_bounds(index, need, q)
    assert first.mean() < 0.2 and VI.clusters_within(index, to_center, limit).mean() < 0.5
    assert index.count.sum() == 3000 and (index.radius <= 2).all()
    ids = [(r["chunk_id"], r["cluster"]) for r in index.rows.collect()]
    assert len({i for i, _ in ids}) == 3000
    # an index made once serves many calls
    a = sorted(map(tuple, R.context_rows(None, qs, max_len=300, index=index).collect()))
    b = sorted(map(tuple, R.context_rows(df, qs, max_len=300).collect()))
    assert [x[0:2] for x in a] == [x[0:2] for x in b] and a


def test_probing_the_nearest_clusters_changes_nothing(spark, monkeypatch):
    from docweave.operators import vector_index as VI
    _, _, df, qs = clustered_chunks(spark, n=1500, seed=3)
    index = R.chunk_index(df)
    a = sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in R.context_rows(None, qs, max_len=300, index=index).collect())
    limits = []
    probed = VI._probed
    monkeypatch.setattr(VI, "PROBE_ROWS", 0)
    monkeypatch.setattr(VI, "_probed", lambda *x: (limits.append((x[-1], probed(*x))), limits[-1][1])[1])
    b = sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in R.context_rows(None, qs, max_len=300, index=index).collect())
    assert a == b and a
    before, after = limits[0]
    assert (after <= before).all() and after.sum() < 0.8 * before.sum()


def test_any_centers_give_the_same_rows(spark):
    from docweave.operators import vector_index as VI
    _, _, df, qs = clustered_chunks(spark, n=400, spread=3.0, seed=5)
    want = None
    for k in (1, 2, 50, 400):
        index = VI.build_index(df, ["chunk_id", "n_tokens"], "embedding", "n_tokens", clusters=k)
        got = sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in R.context_rows(None, qs, max_len=200, index=index).collect())
        want = want or got
        assert got == want and got


def test_ids_of_two_columns_and_huge_ones(spark):
    big = 9_223_372_036_854_775_807
    c = spark.createDataFrame([(big, 1, "b", 10, [1.0, 0.0]), (big, 0, "a", 10, [1.0, 0.0]), (-big, 7, "z", 10, [1.0, 0.0])],
                              "doc_id long, chunk_no int, text string, n_tokens int, embedding array<float>")
    q = spark.createDataFrame([("x", [3.0, 0.0])], "question_id string, q_embedding array<float>")
    assert R.build_context(c, q, id_cols=("doc_id", "chunk_no"), sep="").first()["context"] == "zab"


def test_empty_tables(spark):
    c, q = frames(spark)
    assert {r["context"] for r in R.build_context(c.limit(0), q).collect()} == {""}
    assert R.build_context(c, q.limit(0)).collect() == [] and R.nearest(c.limit(0), q).collect() == []
