"""Workers that cannot import the package, and texts that are hard on the encoder."""

import os
import random
import subprocess
import sys
import time

import public_tokenizers
import sentencepiece

from conftest import ROOT, SMALL
from creaseline.llm import pieces

_SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from creaseline.llm.catalogue import QUERIES
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
tables = dict(op4_warc="pages", op7_embeddings="embeddings", op11_vector_codes="embeddings")
for name in ("op2_language_id", "op4_warc", "op5_suffix_dedup", "op6_simhash", "op7_embeddings", "op8_sentencepiece",
             "op10_token_counts", "op11_vector_codes", "op12_vector_search", "op13_fill_in_middle"):
    rows = QUERIES[name](spark, {small!r}).count()
    if name != "op12_vector_search":
        assert rows == spark.read.parquet(f"{small}/{{tables.get(name, 'documents')}}.parquet").count(), name
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = _SCRIPT.format(root=ROOT, folder=str(tmp_path / "shared"), small=SMALL)
    ended = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=400)
    assert "all ran" in ended.stdout, ended.stderr[-3000:]


def test_long_runs_outside_the_vocabulary():
    """Runs of 50,000 such characters, alone and among others, take time in proportion and equal the library."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.PieceModel.load(path))
    outside = [chr(c) for c in range(0x12000, 0x12100) if chr(c) not in encoder.firsts]
    assert outside
    rng = random.Random(4)
    run = "".join(rng.choices(outside, k=50_000))
    began = time.monotonic()
    texts = [run, run + " word", "word " + run + "word" + run, "".join(rng.choices([*outside, "a", "th", " the", "é"], k=50_000))]
    found = [list(memoryview(encoder.text(t)).cast("i")) for t in texts]
    assert time.monotonic() - began < 20
    assert found == [library.encode(t) for t in texts]
