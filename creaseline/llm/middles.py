"""Fill-in-middle training texts, cut between tokens by rank queries on a wavelet matrix.

A token is a run of ASCII letters or one other character. Each byte of a UTF-8 text has a class: the
first letter of a run, a further letter, the first byte of another character, or a byte that goes on
with it. A wavelet matrix keeps the classes of many texts, one level of bits for each bit of a class;
a rank query counts the bytes of a class before a place. Two ranks combine into the number of tokens
that begin before a place, two others into the number of characters. Both cuts of every text are
located by bisection on these counts, for all texts of a slice at once.

Where the cuts fall follows from a hash of the row's key alone, so a retried task cuts alike.

Defined cases: a null text is an empty text, and an empty text stays plain; a null key is hashed as
an empty string; rows with equal keys and texts are cut alike; a text that holds a marker stays
plain, so every output has one reading; an empty table gives an empty table; other columns are kept,
those called like a new column are replaced. A text is handled whole, whatever its length.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.llm.workers import slices

SEED = 1
FORMED_PERCENT = 90  # of the texts; the others stay plain
SPM_PERCENT = 20  # of those that do not stay plain
MARKERS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle

# Classes of bytes.
RUN_START, RUN_REST, OTHER, TRAIL = range(4)
_ADDED = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


class Bits:
    """Bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    """Rank queries over a sequence of small symbols."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.levels = []
        for bit in reversed(range(n_bits)):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before each place."""
        start = np.zeros(1, dtype=np.int64)
        for bit, bits, zeros in self.levels:
            if symbol >> bit & 1:
                start, at = zeros + bits.rank(start), zeros + bits.rank(at)
            else:
                start, at = start - bits.rank(start), at - bits.rank(at)
        return at - start


def byte_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that begin at `starts`."""
    lower = data | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    goes_on = np.zeros(len(data), dtype=bool)
    goes_on[1:] = letter[:-1]
    goes_on[starts[starts < len(data)]] = False
    classes = np.where(letter, np.where(goes_on, RUN_REST, RUN_START), OTHER).astype(np.uint8)
    classes[(data & 0xC0) == 0x80] = TRAIL
    return classes


class Tokens:
    """Counts of tokens and characters in a stretch of texts, and the places between tokens."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.matrix = WaveletMatrix(byte_classes(data, starts), 2)

    def begun(self, at: np.ndarray) -> np.ndarray:
        """Tokens that begin before each place."""
        return self.matrix.rank(RUN_START, at) + self.matrix.rank(OTHER, at)

    def characters(self, at: np.ndarray) -> np.ndarray:
        return self.begun(at) + self.matrix.rank(RUN_REST, at)

    def cut(self, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where the first `counts` tokens of each text end: the last place before which no more begin."""
        low, high, wanted = starts.copy(), ends.copy(), self.begun(starts) + counts
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.begun(middle) <= wanted
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _draws(key, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def _cut_rows(batch: pa.RecordBatch, key: str, text: str, seed: int, formed: int, spm: int, markers: tuple[str, str, str]):
    """The new columns for the rows of a slice."""
    texts = batch.column(text).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    stored = texts.buffers()[2]
    data = np.frombuffer(stored, dtype=np.uint8)[offsets[0] : offsets[-1]] if stored else np.zeros(0, dtype=np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    tokens = Tokens(data, starts)
    n = tokens.begun(ends) - tokens.begun(starts)
    draws = np.array([_draws(k, seed) for k in batch.column(key).to_pylist()], dtype=np.int64).reshape(-1, 4)
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    first, second = (tokens.cut(starts, ends, count) for count in (np.minimum(one, two), np.maximum(one, two)))
    upto = [tokens.characters(place) for place in (starts, first, second)]
    raw = data.tobytes()
    before = [m.encode() for m in markers]
    forms, outputs = [], []
    for a, b, c, d, h3, h4 in zip(*(x.tolist() for x in (starts, first, second, ends, draws[:, 2], draws[:, 3]))):
        whole, prefix, middle, suffix = raw[a:d], raw[a:b], raw[b:c], raw[c:d]
        if not whole or h3 % 100 >= formed or any(m in whole for m in before):
            form, parts = "plain", [whole]
        elif h4 % 100 < spm:
            form, parts = "spm", [before[1], suffix, before[0], prefix, before[2], middle]
        else:
            form, parts = "psm", [before[0], prefix, before[1], suffix, before[2], middle]
        forms.append(form)
        outputs.append(b"".join(parts))
    plain = np.array([form == "plain" for form in forms], dtype=bool)
    return [
        pa.array(n), pa.array(forms, pa.string()), pa.array(upto[1] - upto[0], mask=plain),
        pa.array(upto[2] - upto[1], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
    ]


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
    formed_percent: int = FORMED_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """`docs` with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output.

    The two counts of characters are null where the form is plain.
    """
    added = [field.name for field in _ADDED]
    replaced = [c for c in docs.columns if c in added and c not in (key, text)]
    rows = docs.drop(*replaced)
    if clash := {key, text} & set(added):
        raise ValueError(f"columns {sorted(clash)} are called like new ones")

    def run(batches):
        for batch in slices(batches, text, 4 << 20):
            made = _cut_rows(batch, key, text, seed, formed_percent, spm_percent, markers)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *added])

    return rows.mapInArrow(run, T.StructType([*rows.schema, *_ADDED]))


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from; a plain output, and one of no known form, is its text.

    No marker can stand across the end of a part, so the first of each kind is the one put there.
    """
    p, s, m = markers
    whole = F.col(output)
    head = F.substring_index(whole, m, 1)
    middle = F.substring(whole, F.char_length(head) + len(m) + 1, F.char_length(whole))

    def parts(one, two):
        first = F.substring_index(head, two, 1)
        second = F.substring(head, F.char_length(first) + len(two) + 1, F.char_length(head))
        return F.substring(first, F.lit(len(one) + 1), F.char_length(first)), second

    prefix, suffix = parts(p, s)
    suffix_first, prefix_second = parts(s, p)
    return (
        F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
        .when(F.col(form) == "spm", F.concat(prefix_second, middle, suffix_first))
        .otherwise(whole)
    )


def digests(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of what `transform` made, with digests of its output and of the text rebuilt from it."""
    return cut.select(
        key, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )
