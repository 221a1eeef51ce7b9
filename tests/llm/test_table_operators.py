"""Sharding, lines, WARC, vectors, decontamination and components against SQL and brute force."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from creaseline.llm import components, decontamination, embeddings, lines, oracles, sharding, simhash, warc
from creaseline.sources import storage


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def sql(query):
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    relation = connection.sql(query)
    return sorted(relation.columns), sorted(map(str, relation.select(*sorted(relation.columns)).fetchall()))


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(r)) for r in frame.select(*columns).collect())


# --- components ---------------------------------------------------------------------------------

def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(1000, 1090)]
    star = [(2000, i) for i in range(2001, 2100)]
    edges = [*rng.integers(0, 300, (220, 2)).tolist(), *chain, *star, (5, 5), (7, None)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = np.array([e for e in edges if None not in e and e[0] != e[1]])
    label = simhash.forest(2100, real[:, 0], real[:, 1])
    nodes = sorted(set(real.ravel().tolist()))
    assert sorted(found) == nodes
    assert [found[n] for n in nodes] == label[nodes].tolist()
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- sharding -----------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [64 << 20, 50_000])
def test_shards_equal_sql(documents, limit):
    shards = sharding.assign(documents.select("doc_id", "text"), limit)
    assert rows_of(shards) == sql(oracles.SHARDING.format(limit=limit))


def test_shard_cases(spark):
    rows = [(1, "x" * 100, "a")] * 30 + [(None, None, "b")] * 3 + [(2, "", "c")] * 4 + [(3, "z" * 5000, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, depth string")
    found = sharding.assign(frame, 1000).collect()
    assert len(found) == 38
    sizes = {}
    for r in found:
        shard = (r["depth"], r["prefix"])
        sizes[shard] = sizes.get(shard, 0) + r["n_bytes"]
        assert r["shard_bytes"] <= 1000 or (r["shard_bytes"] == 5000 and r["shard_rows"] == 1)
    assert all(sizes[r["depth"], r["prefix"]] == r["shard_bytes"] for r in found)
    assert sharding.assign(frame.limit(0), 1000).count() == 0


def test_written_shards(spark, documents, tmp_path):
    path = f"{tmp_path}/shards"
    sharding.write_shards(documents, path, 100_000)
    back = spark.read.parquet(path)
    assert back.count() == documents.count()
    sizes = back.selectExpr("shard", "octet_length(text) n").groupBy("shard").sum("n").collect()
    assert len(sizes) > 1 and all(r[1] <= 100_000 for r in sizes)


# --- lines --------------------------------------------------------------------------------------

def shingles(line):
    units = line.encode("utf-16-be")
    return {units[2 * i : 2 * i + 10] for i in range(max(len(units) // 2 - 5, 0) + 1)}


def plain_lines(rows):
    found, seen = [], {}
    for key, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                found.append((key, at, line.strip(" ")))
                seen.setdefault(line.strip(" "), len(seen))
    sets = [shingles(line) for line in seen]
    a, b = [], []
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                shared = len(x & y)
                if shared >= 0.8 * (len(x) + len(y) - shared):
                    a.append(i), b.append(j)
    label = simhash.forest(len(sets), np.array(a, dtype=int), np.array(b, dtype=int)) if sets else []
    order = lambda o: (o[0] is not None, o[0] or 0, o[1])
    first, gone = {}, {}
    for o in sorted(found, key=order):
        first.setdefault(label[seen[o[2]]], o[:2])
    for key, at, line in found:
        if first[label[seen[line]]] != (key, at):
            gone.setdefault(key, set()).add(at)
    return gone


def test_removed_lines_equal_brute_force(documents):
    some = documents.filter("doc_id < 90").select("doc_id", "text")
    gone = plain_lines([tuple(r) for r in some.collect()])
    found = {r["doc_id"]: set(r["removed"]) for r in lines.judge(some).collect()}
    expected, got = sum(map(len, gone.values())), sum(map(len, found.values()))
    assert expected and sum(len(found[k] - gone.get(k, set())) for k in found) == 0
    assert got >= 0.97 * expected


def test_line_cases(spark):
    long = "The quick brown fox jumps over the lazy dog and runs away"
    rows = [
        (1, f"{long}\n\nab\n ab ", 9, "x"), (2, f"{long}!\nab\nnew line entirely different", 9, "x"), (3, None, 9, "x"),
        (4, "", 9, "x"), (5, "ab", 9, "x"), (5, "ab", 9, "x"), (None, "only here, in a row without key", 9, "x"),
        (6, "y" * 30000, 9, "x"), (7, "y" * 30001, 9, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, removed string")
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()), key=str)
    assert got == sorted([
        (1, f"{long}\n\nab", len(long) + 4), (2, "new line entirely different", 27), (3, None, None), (4, "", 0),
        (5, "", 0), (5, "", 0), (None, "only here, in a row without key", 31), (6, "y" * 30000, 30000), (7, "", 0),
    ], key=str)
    assert {r["doc_id"]: r["n_lines"] for r in lines.judge(docs).collect()} == {1: 3, 2: 3, 3: 0, 4: 0, 5: 1, None: 1, 6: 1, 7: 1}
    assert lines.judge(docs.limit(0)).count() == 0


def test_lines_with_changed_ends(spark):
    url = "https://example.com/" + "abcdefghij" * 9
    pairs = [("Share this page", "Share this page."), ("Advertisement", "Advertisements"), ("Privacy Policy", "Privacy Policy."),
             ("Read more here", "Read more here!"), (url + "k", "X" + url[1:] + "k"), ("日本語の文章には空白がない", "日本語の文章には空白がない。")]
    rows = [(n, line) for n, line in enumerate(line for pair in pairs for line in pair)]
    gone = plain_lines(rows)
    found = {r["doc_id"]: set(r["removed"]) for r in lines.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(gone) == len(pairs)
    assert {k: v for k, v in found.items() if v} == gone


def test_lines_far_from_the_most_frequent(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400)]
    pivot = " ".join(words[:40])
    rows = [(n, pivot) for n in range(50)]
    for n in range(60):  # two near copies each, that share two thirds of their words with the pivot
        own = " ".join(words[:28] + rng.sample(words[40:], 12))
        rows += [(100 + 2 * n, own), (101 + 2 * n, own + " end")]
    gone = plain_lines(rows)
    found = {r["doc_id"]: set(r["removed"]) for r in lines.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(gone) == 49 + 60
    assert {k: v for k, v in found.items() if v} == gone


def test_no_pair_of_a_bucket_is_left_out(spark):
    rows = [(7, n, 0) for n in range(40)]
    tied = spark.createDataFrame([(n, 1) for n in range(1, 20)], "node long, component long")
    pairs = lines.unlinked_pairs(spark.createDataFrame(rows, "band long, hash long, pivot long"), tied)
    own = {n: 1 if 1 <= n < 20 else n for n in range(40)}
    expected = {(a, b) for a in range(1, 40) for b in range(a + 1, 40) if own[a] != own[b]}
    assert sorted(map(tuple, pairs.collect())) == sorted(expected)


def test_bounds_drop_no_similar_pair(spark):
    rng = random.Random(8)
    made = []
    for n in range(25):  # near copies around the threshold, from one shingle to some hundred
        base = "".join(rng.choices("abcdefgh ", k=rng.randint(3, 400))).strip() or "a"
        made.append(base)
        for _ in range(6):
            at = rng.randrange(len(base))
            made.append((base[:at] + "xyz"[: rng.randint(0, 3)] + base[at + rng.randint(0, 3):]).strip() or "b")
    made = sorted(set(made))
    rows = spark.createDataFrame([(m,) for m in made], "line string")
    facts = lines.signed(rows).select("hash", "size", "marks").cache()
    assert facts.count() == len(made)
    named = rows.select("line", lines._hash(F.col("line")).alias("hash")).collect()
    text = {r["hash"]: r["line"] for r in named}
    sets = {h: {t[i : i + 5] for i in range(max(1, len(t) - 4))} for h, t in text.items()}
    assert {r["hash"]: r["size"] for r in facts.collect()} == {h: len(x) for h, x in sets.items()}
    found = spark.createDataFrame([(7, h, 0) for h in text], "band long, hash long, pivot long")
    nothing = spark.createDataFrame([], "node long, component long")
    pairs = {tuple(r) for r in lines.unlinked_pairs(found, nothing, facts).collect()}
    near = {
        (a, b) for a in sets for b in sets
        if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    }
    assert near and near <= pairs
    assert len(pairs) < len(sets) ** 2 / 8


def test_long_unlike_lines_are_no_candidates(spark):
    rng = random.Random(9)
    made = ["".join(rng.choices("abcdefgh ", k=rng.randint(1400, 1600))) for _ in range(30)]
    made = sorted({x.strip() for x in made + [x[:700] + "xyz" + x[700:] for x in made[:5]]})
    rows = spark.createDataFrame([(x,) for x in made], "line string")
    facts = lines.signed(rows).select("hash", "size", "marks").cache()
    found = facts.selectExpr("7L AS band", "hash", "0L AS pivot")
    nothing = spark.createDataFrame([], "node long, component long")
    assert lines.unlinked_pairs(found, nothing, facts).count() == 5


def test_unlike_short_lines_share_few_buckets(spark):
    rng = random.Random(10)
    made = {"".join(rng.choices("abcdefgh", k=32)) + " the end" for _ in range(200)}
    signed = lines.signed(spark.createDataFrame([(x,) for x in sorted(made)], "line string"))
    buckets = {}
    for row in lines.members(signed).collect():
        buckets.setdefault(row["band"], set()).add(row["hash"])
    pairs = {(a, b) for held in buckets.values() for a in held for b in held if a < b}
    assert len(pairs) < 0.02 * len(made) ** 2 / 2


def test_lines_around_the_size_that_parts_the_bands(spark):
    rng = random.Random(11)
    made = []
    for n in range(100, 200, 2):
        base = "".join(rng.choices("abcdefghijklmnop", k=n))
        at = rng.randrange(n - 12)
        made += [base, base[:at] + base[at + rng.randint(1, 6) :], base + "".join(rng.choices("qrstuvw", k=n // 6))]
    rows = list(enumerate(made))
    gone = plain_lines(rows)
    found = {r["doc_id"]: set(r["removed"]) for r in lines.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(gone) >= 90
    assert {k: v for k, v in found.items() if v} == gone


def test_buckets_are_cut_where_sizes_leave_no_room(spark):
    sizes = {1: 100, 2: 90, 3: 300, 4: 310, 5: 1000}
    rows = [(h, h, size, [7] + [None] * (lines.BANDS - 1)) for h, size in sizes.items()]
    found = lines.members(spark.createDataFrame(rows, "hash long, rank long, size int, bands array<int>")).collect()
    assert {(r["hash"], r["pivot"], r["n"]) for r in found} == {(1, 2, 2), (2, 2, 2), (3, 4, 2), (4, 4, 2)}
    assert all(r["fits"] for r in found) and len({(r["band"], r["pivot"]) for r in found}) == 2


@pytest.mark.parametrize("most", [None, 25])
def test_pairs_of_a_bucket_in_blocks_and_in_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "BLOCK", 4)
    sizes = {n: 40 + 3 * n for n in range(40)}
    found = spark.createDataFrame([(7 + n % 2, n, -1, s) for n, s in sizes.items()], "band long, hash long, pivot long, size int")
    facts = spark.createDataFrame([(n, s, [0] * lines.SHARES) for n, s in sizes.items()], "hash long, size int, marks array<long>")
    tied = spark.createDataFrame([(n, 4) for n in range(4, 12)], "node long, component long")
    pairs = lines.unlinked_pairs(found, tied, facts, most).collect()
    expected = {
        (a, b) for a in sizes for b in sizes
        if a < b and (a - b) % 2 == 0 and 5 * sizes[a] >= 4 * sizes[b] and not (4 <= a and b < 12)
    }
    assert sorted(map(tuple, pairs)) == sorted(expected)


def test_line_dedup_shuffles_lines_and_bands_in_parts(spark, monkeypatch):
    stored = []
    keep = lines.written_alone

    def seen(frame, label):
        out = keep(frame, label)
        if label in ("line-signatures", "line-members"):
            stored.append((label, [r["hash"] for r in out.select("hash").collect()]))
        return out

    monkeypatch.setattr(lines, "written_alone", seen)
    some = spark.createDataFrame([(f"line {n} of {n * n} has words of its own and some of all",) for n in range(60)], "line string")
    lines.links(some).collect()
    parts = [held for label, held in stored if label == "line-signatures"]
    assert len(parts) == lines.PARTS > 1 and all(parts)
    assert sorted(h for held in parts for h in held) == sorted(r[0] for r in some.select(lines._hash(F.col("line"))).collect())
    assert sum(label == "line-members" for label, _ in stored) == lines.PASSES > 1


def test_intermediates_of_line_dedup_go(spark):
    rows = [(n, f"The quick brown fox number {n} jumps over the lazy dog and runs\nanother line of {n}") for n in range(12)]
    with storage.run_folder(spark) as folder:
        lines.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        left = {name.rsplit("-", 1)[0] for name in os.listdir(folder.removeprefix("file:"))}
    assert left.isdisjoint({"line-signatures", "line-members", "line-facts", "line-candidates", "line-asked", "line-texts"})
    assert spark.conf.get(storage._FREE_SHUFFLES, "false") == "false"


# --- WARC ---------------------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    big = "x" * 70000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 90000
    rows = [
        (1, "u", None), (2, None, ""), (3, "a\r\nb", "short"), (4, "u", "short"), (5, "u", "L" * 1000), (6, "u", "L" * 1000),
        (6, "u", "L" * 1000), (7, "u", big), (8, "u", big), (None, "u", "n" * 5), (None, "u", big + "2"),
        (9, "u", "\r\n\r\n"), (10, "u", "WARC/1.1\r\n\r\n" * 5000),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")
    warc.write(pages, f"{tmp_path}/w")
    found = warc.read(spark, f"{tmp_path}/w")
    assert found.filter("record_type = 'continuation'").count() >= 4
    back = warc.payloads(warc.reassembled(found))
    bodies = sorted(bytes(r["payload"]) for r in back.filter("record_type = 'response'").collect())
    assert bodies == sorted((h or "").encode() for i, (_, _, h) in enumerate(rows) if i not in (4, 6, 7))
    got = sorted(map(tuple, warc.digests(back).collect()), key=str)
    refers = {5: 6, 7: 8}
    expected = []
    for n, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        again = page in refers or n == 6
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response",
                         refers.get(page, 6) if again else None, True))
    assert got == sorted(expected, key=str)
    warc.write(pages.limit(0), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


def test_damaged_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 200_000)], "page_id long, url string, html string")
    records = [bytes(r[0]) for r in warc.records(pages).collect()]
    assert len(records) > 2
    for n, kept in enumerate((records[:-1], records[1:], [*records[:-1], records[-1][:-9]], records[::-1])):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "a.warc").write_bytes(b"\r\n\r\n".join([*kept, b""]))
        row, = warc.payloads(warc.reassembled(warc.read(spark, f"{tmp_path}/{n}"))).collect()
        assert row["intact"] == (n == 3)


# --- vectors ------------------------------------------------------------------------------------

def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    vectors = np.concatenate([centres + 0.15 * rng.standard_normal((40, 16)) for _ in range(8)] + [rng.standard_normal((100, 16))])
    vectors = np.concatenate([vectors, vectors[:30]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = simhash.forest(len(unit), *np.nonzero(near))
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, leaf=32).collect()}
    links = np.array([found[i]["n_links"] for i in range(len(unit))])
    assert (links <= near.sum(axis=1) - 1).all()
    assert links.sum() >= 0.95 * (near.sum() - len(unit))
    agreeing = sum(found[i]["component_id"] == label[i] for i in range(len(unit)))
    assert agreeing >= 0.97 * len(unit)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [1.0, 0.0]),
            (None, [0.0, 1.0]), (9, [0.0, -1.0]), (9, [0.0, -1.0]), (10, [1e300, 1e300]), (11, []), (12, [inf, 1.0]), (13, [nan, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(frame).collect()), key=str)
    linked = [(1, 2, 1, True), (2, 2, 1, False), (8, 2, 1, False), (9, 1, 9, True), (9, 1, 9, True)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 10, 11, 12, 13, None)]
    assert got == sorted([*linked, *alone], key=str)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_large_group_of_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 300)
    rng = np.random.default_rng(31)
    centre = rng.standard_normal(64)
    spread = rng.standard_normal((1500, 64)) * np.linalg.norm(centre) / 8 * 0.29
    vectors = np.concatenate([centre + spread, rng.standard_normal((700, 64)), -centre + spread[:900]])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = simhash.forest(len(unit), *np.nonzero(near))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, leaf=16).collect()}
    assert [found[i]["n_links"] for i in range(len(unit))] == (near.sum(axis=1) - 1).tolist()
    assert [found[i]["component_id"] for i in range(len(unit))] == label.tolist()


# --- decontamination ----------------------------------------------------------------------------

def test_decontamination_equals_sql(spark, documents):
    from creaseline.llm import catalogue

    assert rows_of(catalogue.op9_decontamination(spark, SMALL)) == sql(oracles.DECONTAMINATION)


@pytest.mark.parametrize("most", [100_000, 8])
def test_decontamination_cases(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    ten = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"
    items = [(1, ten + " w10"), (2, "Tiny Item"), (3, None), (4, "..."), (20, "tiny item"), (5, "never said words"), (1, ten + " w10")]
    docs = [
        (1, f"a {ten} b w10", "x"), (2, f"{ten} W10", "x"), (3, "so TINY, item tiny item", "x"), (4, None, "x"), (5, "", "x"),
        (None, "tiny item", "x"), (6, "w1 w2 w3", "x"), (7, "tiny item", "x"), (7, "clean", "x"), (8, "é" * 20000, "x"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, id string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.judge(frame, benchmark).collect()), key=str)
    assert got == sorted([
        (1, 13, 10, ["1"], True), (2, 11, 11, ["1"], True), (3, 5, 4, ["2", "20"], True), (4, 0, 0, [], False), (5, 0, 0, [], False),
        (None, 2, 2, ["2", "20"], True), (6, 3, 0, [], False), (7, 2, 2, ["2", "20"], True), (7, 1, 0, [], False), (8, 1, 0, [], False),
    ], key=str)
    kept = decontamination.without_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7, 8]
    assert decontamination.without_contaminated(frame, benchmark.limit(0)).count() == len(docs)
    assert decontamination.judge(frame.limit(0), benchmark).count() == 0
