"""The corpus pipeline, stage by stage and as a whole."""

import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from murmuration.llm import line_dedup, mixing, packing, quality, simhash
from murmuration.llm.queries import TOKENIZER


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def tables(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, docs, tmp_path):
    sf_dir = tables(spark, docs, tmp_path)
    cur = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before.append(cur)
        cur = written(spark, stage(spark, cur, sf_dir), tmp_path / f"out{k}")
        if k < 4:
            assert cur.columns == docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    count = lambda df: Counter(map(tuple, df.collect()))
    assert count(before[1]) == count(quality.keep_good(before[0], labels))
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert texts(before[2]) == texts(line_dedup.dedup_lines(before[1]))
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in before[2].collect())
    assert count(before[3]) == count(simhash.keep_one(before[2]))
    assert count(before[4]) == count(mixing.mix(before[3]))
    docs_in = Counter(r["doc_id"] for r in before[4].collect())
    assert Counter(r["doc_id"] for r in cur.where("piece = 0").collect()) == docs_in


def test_run_over_the_small_tables(spark, sf001):
    out = corpus_pipeline.run(spark, sf001)
    assert out.count() > 0
    full = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in full) <= 1024


def test_sequences_can_be_rebuilt_from_the_result(spark, docs, tmp_path):
    last = corpus_pipeline.STAGES[-1][1]
    mixed = docs.where("doc_id between 100 and 210")
    out = written(spark, last(spark, mixed, str(tmp_path)), tmp_path / "out")
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out.collect())
    whole = Tokenizer.from_file(TOKENIZER)
    whole.encode_special_tokens = True
    want = Counter()
    for r in mixed.collect():
        want.update([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    rows = packing.sequences(out).collect()
    got = [np.frombuffer(r["ids"], dtype="<u4").tolist() for r in rows]
    assert [len(x) for x in got] == [r["tokens"] for r in rows] and max(map(len, got)) <= 1024
    assert Counter(i for x in got for i in x) == want


def test_run_over_empty_tables(spark, empty, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, empty, tmp_path)).count() == 0


def test_entry_registers_the_queries():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
