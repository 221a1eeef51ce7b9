"""Vector codes, vector search and fill-in-middle against SQL and brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from conftest import SMALL
from creaseline.llm import catalogue, middles, oracles, vector_codes, vector_search


def sql(query):
    connection = duckdb.connect()
    for name in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    relation = connection.sql(query)
    return sorted(relation.columns), sorted(map(str, relation.select(*sorted(relation.columns)).fetchall()))


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(r)) for r in frame.select(*columns).collect())


# --- fill-in-middle -----------------------------------------------------------------------------

def plain_cut(key, text, seed=1):
    """The contract, character by character."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    one, two = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:one]), "".join(tokens[one:two]), "".join(tokens[two:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(tokens), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_fill_in_middle_equals_sql(spark):
    assert rows_of(catalogue.op13_fill_in_middle(spark, SMALL)) == sql(oracles.FILL_IN_MIDDLE)


def test_fill_in_middle_cases(spark):
    texts = [None, "", "a", " ", "\n\r\n\x00", "abc DEF", "<P>", "a<S>b", "a<M", "P>", "é", "日本語abc日本", "🎉🎉x", "ab" * 40_000,
             "é" * 70_000, " a" * 50_000, "<<P", "word " * 3, "K"]
    rows = [(i * 19 + j if i < 6 else None, t, "kept") for i in range(7) for j, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumnRenamed("form", "extra")
    found = middles.transform(docs)
    assert found.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted(str((k, t, *plain_cut(k, t))) for k, t, _ in rows)
    assert sorted(str((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in found.collect()) == want
    back = found.withColumn("back", middles.restored()).collect()
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_fill_in_middle_replaces_clashing_columns_and_takes_empty_tables(spark):
    clash = spark.createDataFrame([(1, "some words here", "old", 5)], "doc_id long, text string, form string, n int")
    row = middles.transform(clash).first()
    assert (row["n"], row["form"]) == plain_cut(1, "some words here")[:2]
    assert middles.transform(clash.limit(0)).count() == 0
    with pytest.raises(ValueError):
        middles.transform(clash, key="n")


def test_wavelet_rank_counts_symbols():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 4, n).astype(np.uint8)
        matrix = middles.WaveletMatrix(symbols, 2)
        at = np.arange(n + 1)
        for symbol in range(4):
            assert matrix.rank(symbol, at).tolist() == [int((symbols[:k] == symbol).sum()) for k in range(n + 1)]


# --- vector codes -------------------------------------------------------------------------------

def test_vector_codes_equal_sql(spark):
    assert rows_of(catalogue.op11_vector_codes(spark, SMALL)) == sql(oracles.vector_codes())


def plain_codes(points, parts, entries, rounds):
    """Plain k-means in integers on rows that are in the order of their ids."""
    n, width = len(points), points.shape[1] // parts
    x = points.reshape(n, parts, width)
    books, codes = x[:entries].transpose(1, 0, 2).copy(), None
    for done in range(rounds + 1):
        apart = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        codes = apart.argmin(axis=2)
        if done == rounds:
            return codes, apart.min(axis=2).sum(axis=1), books
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[codes[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_vector_codes_equal_plain_k_means(spark, spread):
    """Tight, loose and overlapping groups, one of a third of all rows, with copies and ties."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 12))
    group = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 20, 900))
    vectors = centres[group] + spread * rng.normal(size=(900, 12))
    vectors[100:140] = vectors[0]
    vectors[200:300] = np.round(vectors[200:300])
    frame = spark.createDataFrame([(i, v.tolist(), int(g) if g % 5 else None) for i, (v, g) in enumerate(zip(vectors, group))],
                                  "vec_id long, embedding array<double>, label int").repartition(3)
    coded, books = vector_codes.compress(frame, parts=3, entries=40, rounds=4, scale=64)
    rows = vector_codes.with_label_error(coded).orderBy("vec_id").collect()
    codes, errors, want = plain_codes(np.floor(vectors * 64).astype(np.int64), 3, 40, 4)
    assert books.entries.tolist() == want.tolist()
    assert [list(r["code"]) for r in rows] == codes.tolist()
    assert [r["error"] for r in rows] == errors.tolist()
    labels = [int(g) if g % 5 else None for g in group]
    sums = {}
    for label, error in zip(labels, errors.tolist()):
        sums[label] = sums.get(label, 0) + error
    assert [r["label_error"] for r in rows] == [sums[label] for label in labels]


def test_label_errors_joined_by_shuffle(spark, monkeypatch):
    coded = spark.createDataFrame([(i, i % 3 or None, i) for i in range(50)], "vec_id long, label int, error long")
    broadcast = rows_of(vector_codes.with_label_error(coded))
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
    assert rows_of(vector_codes.with_label_error(coded)) == broadcast


def test_vector_codes_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "x"), (1, [1.0, 2.0, 3.0, 4.0, 5.0], None, "x"), (None, [0.0] * 5, 1, "x"),
            (3, None, 1, "x"), (4, [], 1, "x"), (5, [1.0, nan, 1.0, 1.0, 1.0], 1, "x"), (6, [1.0, -inf, 1.0, 1.0, 1.0], 1, "x"),
            (7, [1.0, None, 1.0, 1.0, 1.0], 1, "x"), (8, [1.0, 2.0], 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, point string")
    coded, books = vector_codes.compress(frame)
    assert books.entries.shape == (4, 3, 2)
    assert sorted((str(r["vec_id"]), r["error"]) for r in coded.collect()) == [("1", 0), ("1", 0), ("None", 0)]
    none, empty = vector_codes.compress(frame.limit(0))
    assert none.count() == 0 and empty.entries.size == 0
    assert vector_codes.with_label_error(none).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9], 1)], frame.schema[:3]))


# --- vector search ------------------------------------------------------------------------------

def plain_nearest(ids, vectors, asked, k):
    """{query: [(id, score)]} by all cosines in double precision."""
    vectors = np.asarray(vectors, dtype=float)
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    out = {}
    for q in asked:
        cosines = units @ units[ids.index(q)]
        ranked = sorted((-round(float(c), 12), i) for c, i in zip(cosines, ids) if i != q)
        out[q] = [(i, -c) for c, i in ranked[:k]]
    return out


def by_query(frame, key="vec_id"):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r[key], round(r["score"], 12)))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_search_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in table]
    want = plain_nearest(ids, [r["embedding"] for r in table], [i for i in ids if i % 50 == 0], 5)
    found = by_query(catalogue.op12_vector_search(spark, SMALL))
    assert found.keys() == want.keys() and all(len(v) == 5 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


@pytest.fixture(scope="module")
def hot_table():
    """Many groups, one of a third of all rows, and copies of some vectors."""
    rng = np.random.default_rng(23)
    centres = rng.normal(size=(60, 16))
    group = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 60, 3000))
    vectors = centres[group] + 0.3 * rng.normal(size=(3000, 16))
    vectors[1000:1030] = vectors[50]
    vectors[2000:2003] = vectors[100]
    return vectors


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (vector_search.FACTOR, 0.9)])
def test_search_in_many_cells_and_shards(spark, monkeypatch, hot_table, factor, least):
    """Small cells, shards and groups of queries; a factor of one is exact."""
    monkeypatch.setattr(vector_search, "SAMPLE", 800)
    monkeypatch.setattr(vector_search, "ASKING", 16)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(hot_table)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    found = by_query(vector_search.nearest(frame, F.col("vec_id") % 50 == 0, factor=factor, shard=100))
    want = plain_nearest(list(range(3000)), hot_table, range(0, 3000, 50), 5)
    hits = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hits >= least * 5 * len(want)
    if factor == 1:
        assert found == want


def test_search_cases(spark):
    from pyspark.sql import functions as F

    nan = float("nan")
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "b"), (1, [2.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [0.0, 0.0], "a"), (4, None, "a"),
            (50, [nan, 1.0], "a"), (6, [None, 1.0], "a"), (100, [1e200, 1e200], "a"), (150, [1.0, 2.0, 3.0], "a"), (None, [1.0, 1.0], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = by_query(vector_search.nearest(frame, F.col("vec_id") % 50 == 0))
    half = round(float(np.sqrt(0.5)), 12)
    assert found == {0: [(1, 1.0), (100, half), (2, 0.0)], 100: [(0, half), (0, half), (1, half), (2, half)]}
    assert vector_search.nearest(frame.limit(0), F.lit(True)).count() == 0
    assert vector_search.nearest(frame, F.lit(False)).count() == 0
