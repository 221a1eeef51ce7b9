"""Language ID, tokenizers, SimHash and repeated substrings against libraries and brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from conftest import SMALL
from creaseline.llm import languages, pieces, simhash, suffixes, transducer

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = list("ab e▁▁  \n\té日本語👍🏽.,;:<>0123'''\"-_()thing\x1c\x00 ıİÉΣς́") + [
    "<s>", "</s>", "<unk>", "<0x0A>", "aaaa", "    ", "http://", "...", "ing", " the",
    "<|startoftext|>", "<|endoftext|>", "'s", "'ll", "'RE",
]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return [*made, None, "", " ", "   ", "a" * 5000 + "th" * 2000, "!" * 9000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with repeated rows, null keys and a clashing column."""
    texts = odd_texts(300)
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[1], rows[1]], "doc_id long, text string, ids string").repartition(3)


# --- encoding -----------------------------------------------------------------------------------

def test_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = pieces.Encoder(pieces.PieceModel.load(PIECES))
    for text in odd_texts(4000):
        ids = np.frombuffer(encoder.text(text), dtype=np.int32)
        assert ids.tolist() == library.encode(text or ""), text
        decoded, = encoder.decoded(ids, np.array([len(ids)]))
        assert decoded == library.decode(ids.tolist()), text


def test_encoding_a_table(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.encode(odd, PIECES).collect()
    assert len(rows) == odd.count()
    for row in rows:
        assert row["ids"] == library.encode(row["text"] or "")
        assert row["decoded"] == library.decode(row["ids"])
    digests = pieces.digests(pieces.encode(odd.limit(3), PIECES)).collect()
    assert {len(r["ids_sha256"]) for r in digests} == {64}
    assert pieces.encode(odd.limit(0), PIECES).count() == 0


# --- token counts -------------------------------------------------------------------------------

def test_counts_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    counter = transducer.Counter(transducer.Compiled.load(WORDS))
    texts = odd_texts(4000)
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert counter.counts(texts).tolist() == expected
    assert counter.counts(texts[:7]).tolist() == expected[:7]
    counter.transducer.restart()
    assert counter.counts(texts).tolist() == expected
    assert counter.counts([]).tolist() == []


def test_words_longer_than_chunks(monkeypatch):
    library = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(transducer, "CHUNK", 7)
    counter = transducer.Counter(transducer.Compiled.load(WORDS))
    texts = ["th" * 40, "ab " * 9 + "x" * 100, "a", None]
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert counter.counts(texts).tolist() == expected


def test_counting_a_table(odd):
    library = Tokenizer.from_file(WORDS)
    rows = transducer.count_tokens(odd, WORDS)
    assert rows.columns == ["doc_id", "ids", "n_bytes", "n_tokens"]
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in rows.collect())
    texts = [r["text"] or "" for r in odd.collect()]
    assert got == sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert transducer.count_tokens(odd.limit(0), WORDS).count() == 0


# --- language ID --------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 5, 9])
def test_codewords_differ(n):
    code = languages.codebook(n)
    assert len({tuple(row) for row in code.tolist()}) == n
    assert set(np.unique(code)) <= {-1, 1}


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = languages.learn(docs, ~languages.held_out())
    assert model.languages == ["de", "en", "es", "fr"]
    rows = languages.predict(docs.withColumn("held", languages.held_out()), model).collect()
    held = [r for r in rows if r["held"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = languages.learn(docs, ~languages.held_out())
    odd = spark.createDataFrame(
        [(1, None, 0.5), (2, "", 0.5), (3, "12 ... !", 0.5), (3, "12 ... !", 0.5), (None, "the and of " * 9000, 0.5), (5, "日本", 0.5)],
        "doc_id long, text string, score double",
    )
    rows = languages.predict(odd, model).collect()
    assert [r["lang_pred"] for r in rows[:5]] == ["und"] * 4 + ["en"]
    assert [r["score"] for r in rows[:4]] == [0.0] * 4
    assert rows[5]["lang_pred"] in model.languages
    assert languages.predict(odd.limit(0), model).count() == 0
    assert languages.learn(docs.limit(0), ~languages.held_out()) is None
    assert {r["lang_pred"] for r in languages.predict(odd, None).collect()} == {"und"}
    kept = languages.without_rejected(odd, None)
    assert kept.columns == odd.columns and kept.count() == 2
    assert languages.without_rejected(odd, model).filter("doc_id IS NULL").count() == 1


def test_labels_teach_only_where_they_may(spark):
    docs = spark.createDataFrame([(i, "aaa bbb", "xx") for i in range(40)], "doc_id long, text string, lang string")
    flagged = docs.withColumn("out", languages.held_out()).collect()
    assert any(r["out"] for r in flagged)
    import zlib
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in flagged)


# --- SimHash ------------------------------------------------------------------------------------

def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [*odd_texts(300), "A b", "a\x0bB\tc\x0cd", "É é x y z"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def components_of(prints, radius=3):
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius, 1))
    return simhash.forest(len(prints), a, b)


def test_links_span_the_components(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(b) for b in range(64)]
    prints = [*centres]
    for centre in centres[:60]:
        near = centre
        for _ in range(rng.integers(1, 9)):
            near = near ^ rng.choice(flips)
            prints.append(near)
    prints = np.unique(np.array([*prints, 0, 1, 2**64 - 1], dtype=np.uint64))
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    for shard in (8, 40, 5000):
        found = simhash.print_links(frame, 3, shard).collect()
        place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
        a = np.array([place[r["a"]] for r in found])
        b = np.array([place[r["b"]] for r in found])
        assert (np.bitwise_count(prints[a] ^ prints[b]) <= 64).all()
        assert simhash.forest(len(prints), a, b).tolist() == components_of(prints).tolist()


def test_near_duplicates_of_a_table(spark):
    texts = ["one two three four five six", "ONE two three four five six", None, "", " \n ", "a", "A", "other words here for sure"]
    rows = [(10 + i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "a", "y")], "doc_id long, text string, component_id string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 10
    prints = {(r["doc_id"], r["print"]) for r in found}
    by_id = {r["doc_id"]: r["component_id"] for r in found}
    assert all((p & (2**64 - 1)) == plain_fingerprint({**dict(r[:2] for r in rows), None: "a"}[i]) for i, p in prints)
    assert by_id[10] == by_id[11] == 10 and by_id[12] == by_id[13] == by_id[14] == 12
    assert by_id[15] == by_id[16] == by_id[None] == 15 and by_id[17] == 17
    kept = simhash.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 10, 12, 15, 17]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# --- repeated substrings ------------------------------------------------------------------------

def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain_removal(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, data in texts:
        for at in range(len(data) - 49) if i is not None else ():
            window = data[at : at + 50]
            first[window] = min(i, first.get(window, i))
    out = []
    for i, data in texts:
        gone = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - 49) if i is not None else ():
            if first[data[at : at + 50]] < i:
                gone[at : at + 50] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        out.append((i, len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removal(frame):
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
         for r in suffixes.remove_repeats(frame).collect()), key=str,
    )


@pytest.mark.parametrize("bucket", [1 << 12, 1 << 24])
def test_repeats_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    rng = random.Random(5)
    parts = ["ab", "a", "é", "the and ", "x" * 30, "-" * 70, "lorem ipsum dolor sit amet consectetur adipiscing elit sed",
             "thequickbrownfoxjumpsoverthelazydog" * 2, "\n"]
    rows = [(rng.choice([None, *range(60)]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for _ in range(120)]
    rows += [(1, None), (2, ""), (70, "q" * 49), (71, "q" * 50), (72, "q" * 500), (73, "q" * 50), (73, "q" * 50)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    assert removal(frame) == plain_removal(rows)


def test_repeats_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).count() == 0


def test_spans_that_share_only_an_anchor_are_not_compared(spark, monkeypatch):
    rng = random.Random(6)
    some = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    shared, passage = some(20), some(60)  # too short for a window; long enough, with different bytes around it
    rows = [(n, some(60) + shared + some(60)) for n in range(40)] + [(n, some(60) + passage + some(60)) for n in (40, 41)]
    asked = []
    monkeypatch.setattr(suffixes, "forget", lambda found: asked.append({r["id"] for r in found.filter("anchor IS NOT NULL").collect()}))
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in found.collect() if r["n_removed"]} == {41: 60}
    assert asked[0] <= {40, 41}


def test_repeats_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert removal(docs) == plain_removal([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_spans_of_an_anchor_shared_by_many(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_SPANS", 20)
    sizes, compared = [], suffixes.repeated_windows
    monkeypatch.setattr(suffixes, "repeated_windows", lambda fetched: sizes.append(fetched.count()) or compared(fetched))
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    phrase = "".join(rng.choices(letters, k=60))
    ends = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(40)]
    rows = [(n % 110, "".join(rng.choices(letters, k=30)) + phrase + rng.choice(ends)) for n in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert removal(frame) == plain_removal(rows)
    assert sum(sizes) > 20
