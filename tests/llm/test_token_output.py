import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkwell.llm import simple8b
from inkwell.llm.token_output import Encoder, read_tokens, token_output, write_tokens


def test_simple8b_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 61, 255, 256, 257, 1000, 5000):
        for top in (1, 2, 200, 50_257, 1 << 30, 1 << 60, 1 << 63):
            v = rng.integers(0, top, n, dtype=np.uint64)
            if n > 3:
                v[rng.integers(0, n, n // 7)] = rng.integers(0, 1 << 63, n // 7, dtype=np.uint64) * 2 + 1
            words, at = simple8b.encode(v)
            assert (simple8b.decode(words, at, n) == v).all()
    v = rng.integers(0, 2, 256, dtype=np.uint64)
    assert len(simple8b.encode(v)[0]) == 5  # 60 to a word


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [None, "", " ", "\n\n", "Don't we'll  you've\t\tI'M it's", "a b c", "x y", "price 12.50€ ½ ²", "naïve Éá", "<|endoftext|> a<|endoftext|>", "nul\x00char", "日本語 text", "a" * 50_000, "tail  ", "\x1c x\x85y", "line\r\nnext\x0b\x0cz", "'S 'll'd'", "aɐb ɏ", "q ’s — end"]


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(2)
    alphabet = list("abcXYZ 0129'.,!-\n\t éßñ —€") + ["'s", "'re", "  ", "the", "\n "]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    ids, lens = Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()).encode(texts, 2)
    at = 0
    for t, n in zip(texts, lens, strict=True):
        assert ids[at : at + n].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], repr(t)
        at += n


def test_files_hold_all_documents_in_order(spark, tokenizer, tmp_path):
    rows = [(i * 7 % 1009, TEXTS[i % len(TEXTS)] if i % 5 else f"document {i} of many") for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(9)
    out = {r.doc_id: r for r in token_output(df).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(out) == 300
    assert token_output(df.limit(0)).collect() == []
    write_tokens(df.where("doc_id < 20"), str(tmp_path / "t"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    for r in read_tokens(spark, str(tmp_path / "t")).collect():
        assert r.ids == [*tokenizer.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids, 2]


def test_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.start) for r in token_output(df).collect()) == [(-1, 0), (3, 2), (3, 4)]


def test_a_third_of_all_rows_may_have_no_id_and_one_text(spark, tmp_path):
    rows = [(None, "the same text in every row")] * 2000 + [(i, f"text {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one part
    try:
        got = token_output(df, path=str(tmp_path / "ids")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(str(tmp_path / "ids")).groupBy("part").sum("n_docs").collect()
    assert len(parts) > 1 and max(r[1] for r in parts) < 3000  # of 6,000 rows, a third of them alike
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert len(got) == 6000 and all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    assert [x[2] for x in starts] == [None] * 2000 + list(range(4000))
