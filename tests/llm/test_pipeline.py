"""The pipeline against a brute-force version, and the registry."""

import re

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as registry
import corpus_pipeline
from conftest import SMALL
from creaseline.sources.storage import written
from test_table_operators import plain_lines
from test_text_operators import plain_fingerprint

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_registry_has_every_operator():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in registry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 90")
    extra = spark.createDataFrame([(900, None, None, None, None), (901, "12 34", "en", "s", 5)], docs.schema)
    docs.union(extra).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_equal_brute_force(spark, some):
    docs = spark.read.parquet(f"{some}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5

    step = written(stages["language_id"](spark, docs, some), "t1")
    assert step.columns == COLUMNS
    assert {r["doc_id"] for r in step.collect()} == {r["doc_id"] for r in docs.collect()} - {900, 901}

    before = [(r["doc_id"], r["text"]) for r in step.collect()]
    step = written(stages["line_dedup"](spark, step, some), "t2")
    gone = plain_lines(before)
    expected = {k: "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone.get(k, ())) for k, t in before}
    texts = {r["doc_id"]: r["text"] for r in step.collect()}
    assert step.columns == COLUMNS and texts == expected
    assert all(r["n_chars"] == len(r["text"]) for r in step.collect())

    step = written(stages["simhash_near_dedup"](spark, step, some), "t3")
    group = {}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    for key in sorted(prints):
        near = {group[k] for k in group if (prints[k] ^ prints[key]).bit_count() <= 3}
        least = min([*near, key])
        group = {k: least if g in near else g for k, g in group.items()} | {key: least}
    staying = {k for k, g in group.items() if k == g}
    assert step.columns == COLUMNS and {r["doc_id"] for r in step.collect()} == staying

    step = written(stages["benchmark_decontamination"](spark, step, some), "t4")
    windows = set()
    for row in spark.read.parquet(f"{some}/benchmark.parquet").collect():
        item = words(row["text"])
        windows |= {tuple(item[i : i + 10]) for i in range(max(len(item) - 9, 1))} if item else set()
    sizes = {len(w) for w in windows}
    clean = {
        k for k in staying
        if not any(tuple(words(texts[k])[i : i + n]) in windows for n in sizes for i in range(len(words(texts[k])) - n + 1))
    }
    assert step.columns == COLUMNS and {r["doc_id"] for r in step.collect()} == clean

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = stages["sentencepiece"](spark, step, some).collect()
    assert {r["doc_id"]: r["ids"] for r in last} == {k: library.encode(texts[k]) for k in clean}

    assert sorted(map(str, corpus_pipeline.run(spark, some).collect())) == sorted(map(str, last))


def test_pipeline_of_no_rows(spark, some):
    docs = spark.read.parquet(f"{some}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, some), f"none-{name}")
        assert docs.count() == 0
