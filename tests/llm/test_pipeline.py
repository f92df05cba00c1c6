import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from inkwell.llm._shared import staged
from inkwell.llm.mixing import mix
from inkwell.llm.queries import MIX_PARTS


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, d = random.Random(1), str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(rng.choice(("th", "er", "on", "ing", "an")) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    items = [(i, prose(40) + ". " + prose(12) + ".") for i in range(5)]
    rows = [(i, prose(rng.randrange(80, 300)), "en", f"src{i % 4}") for i in range(240)]
    bad = [(300 + i, rows[i][1].upper().replace(" ", "!! "), "en", "src1") for i in range(8)]
    near = [(400 + i, rows[i * 5][1] + " more", "en", "src2") for i in range(10)]
    leaked = [(500 + i, prose(60) + " " + items[i % 5][1] + " " + prose(60), "en", "src3") for i in range(10)]
    odd = [(600, None, None, None), (601, "", "en", "src0"), (None, prose(100), "en", "src0")]
    docs = [*rows, *bad, *near, *leaked, *odd]
    rng.shuffle(docs)
    spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_stages_decide_as_planted(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids, kept = {r[0] for r in rows}, {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = staged(out, name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    lost = ids - kept["quality_classifier"]
    assert lost >= set(range(300, 308)) and len(lost - set(range(300, 308))) <= 5
    assert kept["quality_classifier"] - kept["ngram_jaccard_join"] == {i for i in range(400, 410) if i in kept["quality_classifier"] and (i - 400) * 5 in kept["quality_classifier"]}
    assert kept["ngram_jaccard_join"] - kept["benchmark_decontamination"] == set(range(500, 510)) & kept["ngram_jaccard_join"]
    assert kept["mix_sources"] == kept["benchmark_decontamination"]
    order = [r.doc_id for r in mix(docs, MIX_PARTS).orderBy("slot", "start", "doc_id").collect()]
    by_file = docs.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i")
    assert [r.doc_id for r in by_file.collect()] == order
    text, t = {r[0]: r[1] or "" for r in rows}, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = {r.doc_id: r for r in pipeline.token_stage(spark, docs, d).collect()}, 0
    for i in order:
        tokens = [*t.encode(text[i], add_special_tokens=False).ids, 2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)


def test_stages_take_empty_tables(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, d).collect() == []
