"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit one binary classifier tells the languages with a 1 from
those with a 0: a linear one over hashed byte trigrams of the lower-cased words, with the mean log
odds of the two sides as weights. A text's margins are decoded by weighted loss: the distance of a
codeword is the sum over bits of log(1 + exp(-bit * margin)), each bit weighted by how often its
classifier is right for that language. The nearest codeword wins; if the second is hardly farther,
the text is flagged as ambiguous.

The classifiers learn from a sample of labelled rows, `per_language` of each language in expectation
(a documented bound): rows are chosen by a hash of their key, with one share per language, so the
choice does not depend on partitions and needs no shuffle. Predictions read whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text if
nothing can be learned; rows with a null key or language teach nothing; an empty table gives an
empty table; repeated rows are predicted each; an equal distance goes to the first name.
"""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.llm.workers import shipped, slices

PER_LANGUAGE = 2000
SLOTS = 1 << 16
UNKNOWN = "und"
AMBIGUOUS = 0.02  # least difference of the two smallest mean losses
_LEARNING_TASKS = 16
_SHARES = 1_000_000
# Bytes that are no part of a word; others, with all bytes above ASCII, stand for themselves.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def codebook(n: int) -> np.ndarray:
    """Codewords of n languages as rows of -1 and 1: all distinct splits, or, above five languages,
    the random code with the largest smallest distance among 100 seeded ones."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        bits = [[1, *(1 if code >> i & 1 else -1 for i in range(n - 1))] for code in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=np.int8).T
    rng, width = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    codes = (rng.choice(np.array([-1, 1], dtype=np.int8), (n, width)) for _ in range(100))
    return max(codes, key=lambda c: min(int((a != b).sum()) for a, b in combinations(c, 2)))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all trigrams, text after text, and where each text's begin. Slot 0 is for blanks."""
    raw = [b"  " + t.lower().encode("utf-8").translate(_WORDS) + b"  " for t in texts]
    joined = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    begins = np.cumsum([0, *map(len, raw[:-1])])
    a, b, c = joined[:-2], joined[1:-1], joined[2:]
    slots = ((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> 16
    slots[(b == 0x20) & ((a == 0x20) | (c == 0x20))] = 0
    return slots, begins


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # slot x bit
    scale: np.ndarray  # by bit: margins of the sample have a mean size of 4
    trust: np.ndarray  # language x bit, rows sum to 1

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds of each text's trigrams, by bit."""
        slots, begins = trigrams(texts)
        sums = np.add.reduceat(self.weights[slots], begins, axis=0)
        used = np.add.reduceat((slots != 0).astype(np.int64), begins)
        return sums / np.maximum(used, 1)[:, None] * self.scale

    def losses(self, texts: list[str]) -> np.ndarray:
        """Mean loss of each text to each codeword."""
        margins = self.margins(texts)
        each = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (each * self.trust[None]).sum(axis=2)


def _sample(docs: DataFrame, usable: Column, key: str, text: str, lang: str, per_language: int) -> tuple[DataFrame, list[str]]:
    labelled = docs.filter(usable & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, int(_SHARES * min(1.0, per_language / n))).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64(key), F.lit(_SHARES)) < share)
    return drawn.select(F.col(text).alias("text"), F.col(lang).alias("lang")), sorted(counts)


def learn(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """The classifiers, from the rows for which `usable` holds; nothing if none has a label."""
    sample, languages = _sample(docs, usable, key, text, lang, per_language)
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    sample = sample.repartition(_LEARNING_TASKS)

    def tally(batches):
        totals = np.zeros((len(languages), SLOTS), dtype=np.int64)
        for batch in slices(batches, "text"):
            slots, begins = trigrams(batch.column("text").to_pylist())
            ids = np.array([number[name] for name in batch.column("lang").to_pylist()])
            ids = np.repeat(ids, np.diff(begins, append=len(slots)))
            np.add.at(totals, (ids, slots), 1)
        rows = [totals.astype("<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["counts"])

    # One row for each of the few learning tasks, whatever the size of the table.
    counts = np.zeros((len(languages), SLOTS))
    for row in sample.mapInArrow(tally, "counts binary").toLocalIterator():
        counts += np.frombuffer(row[0], dtype="<i8").reshape(counts.shape)
    counts[:, 0] = 0
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codebook(len(languages))
    weights = np.zeros((SLOTS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        one = code[:, bit] > 0
        if one.any() and not one.all():
            weights[:, bit] = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
    weights[0] = 0
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))

    def judge(batches):
        sums = np.zeros((3, *code.shape))
        for batch in slices(batches, "text", 1 << 20):
            ids = np.array([number[name] for name in batch.column("lang").to_pylist()])
            margins = model.margins(batch.column("text").to_pylist())
            for at, values in enumerate((np.abs(margins), margins * code[ids] > 0, np.ones_like(margins))):
                np.add.at(sums[at], ids, values)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    sums = sum(np.frombuffer(r[0]).reshape(3, *code.shape) for r in sample.mapInArrow(judge, "sums binary").toLocalIterator())
    model.scale = 4 * sums[2].sum(axis=0) / np.maximum(sums[0].sum(axis=0), 1e-9)
    right = (sums[1] + 1) / (sums[2] + 2)
    model.trust = right / right.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and ambiguous; columns of these names are replaced."""
    new = ["lang_pred", "score", "ambiguous"]
    keep = [c for c in docs.columns if c not in new]
    rows = docs.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([
        *rows.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
    ])
    shared = shipped(docs.sparkSession, model)

    def run(batches):
        model = shared()
        for batch in slices(batches, text, 1 << 20):
            texts = batch.column(text).to_pylist()
            names, scores, doubts = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            with_letters = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            if with_letters:
                losses = model.losses([texts[i] for i in with_letters])
                best = losses.argmin(axis=1)
                near = np.exp((losses.min(axis=1, keepdims=True) - losses) * model.code.shape[1])
                scores[with_letters] = 1 / near.sum(axis=1)
                if losses.shape[1] > 1:
                    two = np.partition(losses, 1, axis=1)
                    doubts[with_letters] = two[:, 1] - two[:, 0] < AMBIGUOUS
                for i, b in zip(with_letters, best.tolist()):
                    names[i] = model.languages[b]
            columns = [*batch.columns, pa.array(names), pa.array(scores), pa.array(doubts)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *new])

    return rows.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept out of learning."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def without_rejected(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents that get a language and no ambiguity flag; if nothing could be learned, those
    with a letter."""
    if model is None:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    judged = predict(docs, model, text)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*[f"`{c}`" for c in docs.columns])
