"""The tables that a stage's result reads go once the next stage reads what was written, and no sooner."""

from __future__ import annotations

import time

import corpus_pipeline as c

from tessella.llm import common

SF = "/root/testdata/sf0.001"


def tables(spark) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(path) if x.getPath().getName().startswith("numbered-")]


def test_one_stage_at_a_time(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i // 2} " * 40) for i in range(20)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    docs, before = spark.read.parquet(f"{tmp_path}/in"), set(tables(spark))
    first = c.exact_dedup(spark, docs, SF)
    made = set(tables(spark)) - before
    assert len(made) == 1
    c.exact_dedup(spark, docs, SF)  # on an input that is older: nothing goes
    c.exact_dedup(spark, first, SF)  # nor where the result itself is read
    assert made <= set(tables(spark)) and first.count() == 10
    time.sleep(0.05)
    first.write.parquet(f"{tmp_path}/first")
    second = c.near_dedup(spark, spark.read.parquet(f"{tmp_path}/first"), SF)
    assert not made & set(tables(spark)) and second.count() == 10


def test_packing_bounds_its_cache():
    from tessella.llm.encoding import encoder

    path = common.default_tokenizer("word_bpe_49k.json")
    small = encoder(path, c.WORD_BYTES)
    assert small.words.most == c.WORD_BYTES < encoder(path).words.most
    texts = ["a few words", "Words, and others"]
    assert small.encode(texts) == encoder(path).encode(texts)
