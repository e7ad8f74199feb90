import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import token_count, token_ids
from docweave.llm.queries import BYTE_BPE, PIECE_MODEL, tokenizer

HAND = ["", " ", "  ", "\n", "a\n", "\na", " \n a", "a \nb", "a  b", "▁", "a▁b▁▁c", "x\ty\r\nz", "<|endoftext|>",
        "a <|endoftext|> b<|endoftext|>.", "é ñ \xa0 　 x", "don't I'll 'S x's dogs' .", "a\n\nb", "\x00 a\x01b \x00", "\x1c \x1d a",
        "a.\nB, c; 12 34a5 \n", "<s> </s> <unk>", "日本 語\n漢 字", "ﬁ Ａ é", "\ue000 x \ue000", "end... of?! it!", "a" * 5000, "\ud7ff 😀😀 x"]


def texts():
    r = random.Random(5)
    letters = list(" \n ab'.é▁\t\x00 ,<|1\xa0!")
    return HAND + ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def byte_encoder():
    return token_ids.Encoder(tokenizer(BYTE_BPE))


def test_pieces_give_the_librarys_ids(byte_encoder):
    got, n = byte_encoder.encode(pa.array(texts()))
    want = [e.ids for e in byte_encoder.tok.encode_batch(texts(), add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want]
    assert got.tolist() == [i for w in want for i in w]


def test_words_of_letters_go_to_the_model(byte_encoder, monkeypatch):
    """They need no pass of the whole library; all other pieces take one."""
    e, whole = token_ids.Encoder(tokenizer(BYTE_BPE)), []
    monkeypatch.setattr(e, "_ids", lambda texts: whole.extend(texts) or [x.ids for x in e.tok.encode_batch_fast(texts, add_special_tokens=False)])
    every = ["one straße\nécole 日本語 слово one", "two x1y isn't, one"]
    ids, _ = e.encode(pa.array(every))
    assert ids.tolist() == [i for x in e.tok.encode_batch(every, add_special_tokens=False) for i in x.ids]
    said = "".join(whole)
    assert all(w not in said for w in ("straße", "école", "語", "слово")) and "x1y" in said and "isn't" in said


def test_every_letter_gives_the_librarys_ids():
    """Also characters that Python takes for letters and the library does not."""
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    every = [" ".join(f"a{c} {c}b{c}\n{c}" for c in letters[i:i + 200]) for i in range(0, len(letters), 200)]
    e = token_ids.Encoder(tokenizer(BYTE_BPE))
    ids, _ = e.encode(pa.array(every))
    assert ids.tolist() == [i for x in e.tok.encode_batch(every, add_special_tokens=False) for i in x.ids]
    e.foreign, e.spelling = {"é"}, {}
    e._clear()
    some = ["é aé", "b\né c"]
    assert e.encode(pa.array(some))[0].tolist() == [i for x in e.tok.encode_batch(some, add_special_tokens=False) for i in x.ids]


def test_special_strings_of_letters(tmp_path):
    tok = token_ids.Encoder(tokenizer(BYTE_BPE)).tok
    tok.add_tokens(["house"])
    tok.save(str(tmp_path / "t.json"))
    every = ["a house", "houses and\nhouse", "warehouse", "hous e", "mouse\nhouse hous"]
    ids, _ = token_ids.Encoder(str(tmp_path / "t.json")).encode(pa.array(every))
    assert ids.tolist() == [i for x in tok.encode_batch(every, add_special_tokens=False) for i in x.ids]


def test_slices_are_looked_up_together(byte_encoder, monkeypatch):
    """One search of the memo for a batch, whatever its slices; the memo is
    cut down after it."""
    e, calls = token_ids.Encoder(tokenizer(BYTE_BPE), memo=300), []
    rows = e._rows
    monkeypatch.setattr(e, "_rows", lambda *a: calls.append(1) or rows(*a))
    every = texts()
    got = list(e.blocks(pa.array(every), limit=200))
    assert len(got) > 50 and len(calls) == 1 and len(e.keys) <= 300
    want = byte_encoder.encode(pa.array(every))
    assert (np.concatenate([i for i, _ in got]) == want[0]).all() and (np.concatenate([n for _, n in got]) == want[1]).all()
    assert list(e.blocks(pa.array([], pa.string()))) == []


def test_small_memo_gives_the_same(byte_encoder):
    e = token_ids.Encoder(tokenizer(BYTE_BPE), memo=40)
    every = texts()
    for i in range(0, 600, 30):
        a, b = e.encode(pa.array(every[i:i + 30])), byte_encoder.encode(pa.array(every[i:i + 30]))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_other_tokenizers_fall_back_to_whole_texts():
    e = token_ids.Encoder(tokenizer("word_bpe_49k.json"))
    assert not e.cut
    ids, _ = e.encode(pa.array(HAND))
    assert ids.tolist() == [i for w in e.tok.encode_batch(HAND, add_special_tokens=False) for i in w.ids]


def test_counts_are_the_librarys():
    path = tokenizer(PIECE_MODEL)
    c = token_count.Counter(path, memo=100)
    every = texts()
    want = [len(x) for x in token_count._model(path).encode(every, num_threads=1)]
    assert [n for i in range(0, len(every), 50) for n in c.count(every[i:i + 50])] == want


def test_whole_tokens_are_single():
    path = tokenizer(PIECE_MODEL)
    whole = sorted(token_count.whole_tokens(path))
    assert len(whole) > 10_000
    assert all(len(x) == 1 for x in token_count._model(path).encode(whole[:3000], num_threads=1))


def test_json_counts(spark, odd_docs):
    rows = token_count.token_counts(odd_docs, tokenizer(BYTE_BPE)).collect()
    tok = token_ids.Encoder(tokenizer(BYTE_BPE)).tok
    want = sorted(len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in odd_docs.collect())
    assert sorted(r.n_tokens for r in rows) == want


def test_counts_on_odd_rows(odd_docs, no_docs, clashing):
    path = tokenizer(PIECE_MODEL)
    sp = token_count._model(path)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd_docs.collect())
    for d in (odd_docs, clashing):
        got = token_count.token_counts(d, path).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_count.token_counts(no_docs, path).collect() == []


def test_files_round_trip(spark, odd_docs, no_docs, clashing, tmp_path):
    path = tokenizer(BYTE_BPE)
    tok = token_ids.Encoder(path).tok
    for k, d in enumerate((odd_docs, clashing)):
        out = str(tmp_path / f"ids{k}")
        token_ids.write_token_ids(d, out, path, page_ids=1000)
        docs = sorted(token_ids.read_documents(spark, out).collect(), key=lambda r: r.start)
        want = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in d.collect())
        assert [r.doc_id for r in docs] == [i if some else None for (some, i), _ in want]
        assert sorted(map(tuple, (r.ids for r in docs))) == sorted(
            (*tok.encode(t, add_special_tokens=False).ids, 0) for _, t in want)
        index = sorted(token_ids.read_index(spark, out).collect(), key=lambda r: r.start)
        at = 0
        for a, b in zip(index, docs):
            assert (a.start, a.n_tokens) == (at, len(b.ids))
            assert a.ids_crc32 == zlib.crc32(np.array(b.ids, "<u4").tobytes())
            at += a.n_tokens
    out = str(tmp_path / "none")
    token_ids.write_token_ids(no_docs, out, path)
    assert token_ids.read_index(spark, out).collect() == []
