"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

The tokenizer lower-cases and composes a text, cuts it into words and merges byte pairs inside each
word, whose last symbol carries an end mark. Its counts come from a deterministic transducer over
bytes:

* A state is what the part of a word read so far can still tell: its longest suffix that some token
  starts with or ends a word with, and for every cut inside that suffix the last token before the
  cut and the number of tokens up to it, relative to now. The last token of each longer prefix
  follows from these, since exactly one token fits its predecessor (the pair merges back to itself).
* A transition carries the change of the count; the change on the word's end settles its last token.
  Changes add up to the number of tokens.
* States are compiled when they are first reached and dropped when they become too many, so the
  table is bounded.

A stretch of text is cut into chunks that run in step. A chunk is a map from the state before it to
the state after it. If a word ends inside, that map is constant: all states meet at the word's end.
A prefix scan composes the maps, and then each chunk's head, up to its first word end, is run from
the state found. Words longer than a chunk pass their state from chunk to chunk.

Defined cases: a null or empty text has 0 bytes and 0 tokens; an empty table gives an empty table;
repeated rows are counted each; an added token's text inside a text is one token, as is the
tokenizer's default. Columns of the input called like a new column are replaced.
"""

import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from creaseline.llm.workers import kept, shipped, slices

CHUNK = 2048
MOST_STATES = 200_000
END = "</w>"
SPACES, LETTER, NUMBER, OTHER = range(4)
# The clitics that the tokenizer's word pattern names, without their apostrophe.
CLITICS = ("s", "t", "re", "ve", "m", "ll", "d")
# Fixed value: the word pattern of the tokenizer kind that is compiled here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@dataclass
class Compiled:
    """What the tasks need of a tokenizer file: merges, added tokens, and tables by code point."""

    ranks: dict[tuple[str, str], int]
    tokens: list[str]
    added: list[str]
    kinds: np.ndarray
    lower: np.ndarray

    @classmethod
    def load(cls, path: str) -> "Compiled":
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, first = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if (
            model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["ignore_merges"]
            or kinds != ["NFC", "Replace", "Lowercase"] or first["pattern"]["Regex"] != WORDS
        ):
            raise ValueError(f"{path} is no lower-casing byte-level BPE with word ends")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        added = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        ranks = {pair: i for i, pair in enumerate(merges)}
        return cls(ranks, list(model["vocab"]), added, *_code_points())


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each code point, as the tokenizer's own parts have them."""
    points = np.array([*range(1, 0xD800), *range(0xE000, 0x110000)])
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, points.tolist()))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACES, r"\s")):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
        kinds[points[[place[0] for _, place in found]]] = kind
    lower = np.arange(0x110000, dtype=np.uint32)
    points = points[points != 0x130]  # the only one whose lower case has two code points
    lower[points] = [ord(c) for c in normalizers.Lowercase().normalize_str("".join(map(chr, points.tolist())))]
    return kinds, lower


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


class Transducer:
    """States and transitions, compiled on demand. Column 0 of the table is the word's end."""

    def __init__(self, compiled: Compiled):
        self.ranks = compiled.ranks
        self.opens = {t for t in compiled.tokens if not t.endswith(END)}
        self.closes = {t[: -len(END)] for t in compiled.tokens if t.endswith(END)}
        self.opens = {t for t in self.opens if self.merged(list(t)) == [t]}
        self.closes = {t for t in self.closes if self.merged(self.closed(t)) == [t + END]}
        starts = {t[:n] for t in self.opens | self.closes for n in range(1, len(t))}
        self.suffixes = starts | self.closes
        self.symbols = byte_symbols()
        self.restart()

    def restart(self) -> None:
        first = ("", ("",), (0,))
        self.states, self.keys = {first: 0}, [first]
        self.fits: dict = {}
        self.column = np.full(256, -1, dtype=np.int64)
        self.byte_of: list[int] = [-1]
        self.table = np.full((1024, 40), -1, dtype=np.int32)

    @staticmethod
    def closed(token: str) -> list[str]:
        return [*token[:-1], token[-1] + END]

    def merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            ranked = [self.ranks.get(pair, len(self.ranks)) for pair in zip(parts, parts[1:])]
            best = min(ranked)
            if best == len(self.ranks):
                break
            at = ranked.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, last: str, token: str, close: bool) -> bool:
        if not last:
            return True
        key = (last, token, close)
        found = self.fits.get(key)
        if found is None:
            pair = [*last, *(self.closed(token) if close else token)]
            found = self.fits[key] = self.merged(pair) == [last, token + END if close else token]
        return found

    def step(self, state: int, column: int) -> int:
        """The packed transition: the next state and, in the low byte, the count's change + 128."""
        suffix, lasts, counts = self.keys[state]
        if column == 0:
            for n in range(len(suffix)):
                if suffix[n:] in self.closes and self.fit(lasts[n], suffix[n:], True):
                    return counts[n] + 1 + 128
            raise ValueError(f"no token ends the word at {suffix!r}")
        suffix += self.symbols[self.byte_of[column]]
        for n in range(len(suffix)):
            if suffix[n:] in self.opens and self.fit(lasts[n], suffix[n:], False):
                lasts, change = (*lasts, suffix[n:]), counts[n] + 1
                break
        else:
            raise ValueError(f"no token ends at {suffix!r}")
        counts = (*(c - change for c in counts), 0)
        keep = 0
        while keep < len(suffix) and suffix[keep:] not in self.suffixes:
            keep += 1
        key = (suffix[keep:], lasts[keep:], counts[keep:])
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
        return found << 8 | change + 128

    def columns(self, raw: np.ndarray) -> np.ndarray:
        """Table columns of bytes."""
        for b in np.flatnonzero(np.bincount(raw, minlength=256)):
            if self.column[b] < 0:
                self.column[b] = len(self.byte_of)
                self.byte_of.append(int(b))
        if len(self.byte_of) > self.table.shape[1]:
            self.table = np.pad(self.table, ((0, 0), (0, 40)), constant_values=-1)
            return self.columns(raw)
        return self.column[raw]

    def compile(self, places: np.ndarray) -> None:
        """Fill transitions, given as places in the flat table."""
        width = self.table.shape[1]
        for place in np.unique(places).tolist():
            self.table[place // width, place % width] = self.step(*divmod(place, width))
            if len(self.keys) > len(self.table):
                self.table = np.pad(self.table, ((0, len(self.table)), (0, 0)), constant_values=-1)

    def run(self, stream: np.ndarray, begin: np.ndarray, stop: np.ndarray, state: np.ndarray, change: np.ndarray) -> np.ndarray:
        """Run pieces of the stream in step from their states; fills `change`, gives final states."""
        order = np.argsort(begin - stop, kind="stable")  # the longest first
        at, state, length = begin[order], state[order].copy(), (stop - begin)[order]
        width = self.table.shape[1]
        flat = self.table.reshape(-1)
        running = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for n in running.tolist():
            places = state[:n] * width + stream[at[:n]]
            packed = flat[places]
            if (missing := packed < 0).any():
                self.compile(places[missing])
                flat = self.table.reshape(-1)
                packed = flat[places]
            state[:n] = packed >> 8
            change[at[:n]] = (packed & 255) - 128
            at[:n] += 1
        out = np.empty_like(state)
        out[order] = state
        return out

    def changes(self, stream: np.ndarray) -> np.ndarray:
        """The count's change on every symbol of the stream, which ends with a word's end."""
        change = np.zeros(len(stream), dtype=np.int16)
        begin = np.arange(0, len(stream), CHUNK)
        stop = np.minimum(begin + CHUNK, len(stream))
        ends = np.append(np.flatnonzero(stream == 0), len(stream))
        first = ends[np.searchsorted(ends, begin)]
        constant = first < stop
        after = np.where(constant, first + 1, stop)
        # The part after a chunk's first word end starts from state 0, whatever came before.
        out = self.run(stream, after, stop, np.zeros(len(begin), dtype=np.int64), change)
        # Prefix scan over the chunks' maps. A constant map composed with any map is itself; only
        # chunks inside one long word depend on their predecessor, and go in further rounds.
        ready = np.append(True, constant[:-1])
        done = np.zeros(len(begin), dtype=bool)
        before = np.append(0, out[:-1])
        while not done.all():
            now = np.flatnonzero(ready & ~done)
            heads = self.run(stream, begin[now], after[now], before[now], change)
            done[now] = True
            passing = now[~constant[now]]
            out[passing] = heads[~constant[now]]
            following = passing[passing + 1 < len(begin)] + 1
            before[following], ready[following] = out[following - 1], True
        return change


class Counter:
    """Counts tokens of texts with a compiled tokenizer."""

    def __init__(self, compiled: Compiled):
        self.kinds, self.lower = compiled.kinds, compiled.lower
        self.added = re.compile("|".join(map(re.escape, compiled.added)) or r"(?!)")
        self.transducer = Transducer(compiled)

    def prepared(self, text: str) -> tuple[str, int]:
        """The composed text without added tokens, and how many of these there were."""
        text, n = self.added.subn("\n", text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("İ", "i̇")
        return text, n

    def starts(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where words start: a change of kind, each number, and around clitics."""
        starts = np.ones(len(points), dtype=bool)
        starts[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        quotes = np.flatnonzero(starts & (points == ord("'")))
        quotes = quotes[quotes + 1 < len(points)]
        for clitic in CLITICS:
            here = quotes[quotes + len(clitic) < len(points)]
            for n, letter in enumerate(clitic, 1):
                here = here[points[here + n] == ord(letter)]
            starts[here + 1] = False
            after = here + len(clitic) + 1
            after = after[after < len(points)]
            starts[after] = True
        return starts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        prepared = [self.prepared(t or "") for t in texts]
        points = np.frombuffer("\n".join([t for t, _ in prepared]).encode("utf-32-le"), dtype=np.uint32)
        total = np.array([n for _, n in prepared], dtype=np.int64)
        if not len(points):
            return total
        if len(self.transducer.keys) > MOST_STATES:
            self.transducer.restart()
        lengths = np.array([len(t) + 1 for t, _ in prepared])
        points = self.lower[points]
        kinds = self.kinds[points]
        starts = self.starts(points, kinds)
        inside = kinds != SPACES
        ends = inside.copy()
        ends[:-1] &= starts[1:] | ~inside[1:]
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        width = np.where(inside, size + ends, 0)
        upto = np.cumsum(width)
        stream = np.zeros(int(upto[-1]), dtype=np.int64)
        raw = np.frombuffer(points[inside].tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
        symbol = np.ones(len(stream), dtype=bool)
        symbol[upto[ends] - 1] = False
        stream[symbol] = self.transducer.columns(raw)
        if len(stream):
            change = np.concatenate([[0], np.cumsum(self.transducer.changes(stream), dtype=np.int64)])
            last = np.minimum(np.cumsum(lengths) - 1, len(points) - 1)
            total += np.diff(change[upto[last]], prepend=0)
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """`docs` with `n_bytes` (UTF-8) and `n_tokens` of each whole text, in place of the text."""
    compiled = shipped(docs.sparkSession, Compiled.load(tokenizer_path))
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", text)]
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias("n_tokens"))
    schema = T.StructType(
        [*rows.schema[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches):
        counter = kept(f"transducer {tokenizer_path}", lambda: Counter(compiled()))
        for batch in slices(batches, "n_tokens", 4 << 20):
            column = batch.column(len(keep))
            size = pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64())
            found = pa.array(counter.counts(column.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], size, found], [*keep, "n_bytes", "n_tokens"]
            )

    return rows.mapInArrow(run, schema)
