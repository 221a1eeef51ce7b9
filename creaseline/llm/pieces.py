"""Exact encoding and decoding for merge-type SentencePiece models.

The model merges, again and again, the adjacent pair whose concatenation is the best-scored piece.
That result is the only sequence of pieces in which every piece survives its own merging and every
adjacent pair is compatible: merging the two pieces' text again gives back the same two. So a
segment is encoded without a priority queue:

1. An Aho-Corasick automaton finds the longest piece at a position; its shorter alternatives are the
   pieces that it starts with.
2. From the left the longest piece is taken that is compatible with its predecessor (compatibility
   is found by re-merging the pair, and remembered).
3. If none fits, the position is marked in a bitfield of failed positions, the last piece is given
   up, and its next shorter alternative is tried. No position fails twice.

A text is first cut where no piece can span: between a character and a following one that never
stand side by side in any piece. Segments repeat, so a worker remembers the short ones, up to a
fixed number. Characters outside the vocabulary become their UTF-8 bytes.

Defined cases: a null text is an empty text; an empty text has no ids and decodes to an empty text;
an empty table gives an empty table; repeated rows are encoded each; other columns are kept.
"""

import re
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.llm.workers import kept, shipped, slices

SPACE = "▁"
REMEMBERED_CHARS = 48
REMEMBERED = 200_000


@dataclass
class PieceModel:
    """Pieces with their scores, read from a model file on the driver; sent to the tasks whole."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    bytes_of: list[bytes]  # by id: what it decodes to
    usable: set[str] = field(default_factory=set)
    segments: str = ""
    cut_at_spaces: bool = True

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, bytes_of, byte_ids = {}, {}, [], [0] * 256
        for i in range(reader.get_piece_size()):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif reader.is_control(i):
                bytes_of.append(b"")
            elif reader.is_unknown(i):
                bytes_of.append(" ⁇ ".encode())
            else:
                ids[piece], scores[piece] = i, reader.get_score(i)
                bytes_of.append(piece.replace(SPACE, " ").encode())
        model = cls(ids, scores, byte_ids, bytes_of)
        model.usable = {piece for piece in ids if model.merged(piece) == [piece]}
        model.segments = model._segment_pattern()
        return model

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _segment_pattern(self) -> str:
        """Cuts before each run of marks, and before each space, if no piece spans such a place."""
        follows = {(a, b) for piece in self.ids for a, b in zip(piece, piece[1:])}
        if any(b == SPACE and a != SPACE for a, b in follows):
            self.cut_at_spaces = False
            return r"(?s).+"
        marks = {chr(c) for c in range(128) if not chr(c).isalpha()}
        before = None
        while before != marks:
            before = set(marks)
            marks |= {a for a, b in follows if b in marks and not a.isalpha() and a != SPACE}
            marks -= {b for a, b in follows if b in marks and a.isalpha()}
        group = "".join(map(re.escape, sorted(marks)))
        other = f"[^{group}{SPACE}]"
        return f"{SPACE}+[{group}]*{other}*|[{group}]+{other}*|{other}+"

    def shorter(self, piece: str) -> str:
        """The next shorter piece that `piece` starts with, or nothing."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.usable), "")


class Remembered(dict):
    """Values by key, made on demand; keys of up to `chars` characters are remembered."""

    def __init__(self, make, chars: int):
        super().__init__()
        self.make, self.chars = make, chars

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.chars:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts with a model; holds the automaton and what it remembers."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.find = re.compile(model.segments).findall
        self.automaton = ahocorasick.Automaton()
        for piece in model.usable:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.firsts = {piece[0] for piece in model.usable}
        self.longest = max(map(len, model.usable), default=1)
        self.shorter = {piece: model.shorter(piece) for piece in model.usable}
        self.fits = Remembered(lambda pair: model.merged("".join(pair)) == list(pair), 2)
        self.fitting = Remembered(self.first_fitting, 2)
        self.segments = Remembered(self.ids, REMEMBERED_CHARS)
        self.words = Remembered(lambda word: self.run(SPACE + word), REMEMBERED_CHARS)
        lengths = [len(s) for s in model.bytes_of]
        self.lengths = np.array(lengths)
        self.starts = np.cumsum([0, *lengths[:-1]])
        self.blob = np.frombuffer(b"".join(model.bytes_of), dtype=np.uint8)

    def first_fitting(self, pair: tuple[str, str]) -> str:
        """Of a piece and its shorter alternatives, the longest compatible with the one before."""
        last, piece = pair
        while piece and last and not self.fits[last, piece]:
            piece = self.shorter.get(piece, "")
        return piece

    def pieces(self, segment: str) -> list[str]:
        """The pieces of a segment; a character outside the vocabulary stands for itself."""
        n = len(segment)
        failed = bytearray(n // 8 + 1)
        fitting, shorter, longest = self.fitting, self.shorter, self.automaton.iter_long
        firsts, reach = self.firsts, self.longest
        taken: list[str] = []
        at, last, piece = 0, "", None
        while at < n:
            if piece is None:
                end, piece = -1, segment[at]
                if piece in firsts:  # looked up first, as the search would run on to the next match
                    end, piece = next(longest(segment, at, min(n, at + reach)), (-1, ""))
                    if not piece or end - len(piece) + 1 != at:
                        piece = segment[at]
            piece = fitting[last, piece]
            while piece and failed[(end := at + len(piece)) >> 3] >> (end & 7) & 1:
                piece = fitting[last, shorter.get(piece, "")]
            if piece:
                taken.append(piece)
                at += len(piece)
                last, piece = piece, None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()  # its end has failed now, so a shorter one will be taken
                at -= len(piece)
                last = taken[-1] if taken else ""
        return taken

    def ids(self, segment: str) -> list[int]:
        ids, byte_ids = self.model.ids, self.model.byte_ids
        found: list[int] = []
        for piece in self.pieces(segment):
            if piece in ids:
                found.append(ids[piece])
            else:
                found.extend([byte_ids[b] for b in piece.encode("utf-8")])
        return found

    def run(self, text: str) -> bytes:
        """Ids of a text that starts with its space, as packed 32-bit integers."""
        ids: list[int] = []
        segments = self.segments
        for segment in self.find(text.replace(" ", SPACE)):
            ids += segments[segment]
        return array("i", ids).tobytes()

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if self.model.cut_at_spaces and text[0] != " " and "  " not in text:
            words = self.words
            return b"".join([words[word] for word in text.split(" ")])
        return self.run(SPACE + text)

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the sequences that end at `ends`; the space put first is taken off again."""
        sizes = self.lengths[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.starts[ids] - upto[:-1], sizes) + np.arange(upto[-1])
        raw = self.blob[source].tobytes()
        texts, start = [], 0
        for end in upto[ends].tolist():
            text = raw[start:end].decode("utf-8", "replace")
            texts.append(text[1:] if text[:1] == " " else text)
            start = end
        return texts


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with the ids of each whole text and the text that these ids decode to.

    Columns of `docs` called like a new column are replaced.
    """
    spark = docs.sparkSession
    model = shipped(spark, PieceModel.load(model_path))
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    rows = docs.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*rows.schema, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches):
        encoder = kept(f"pieces {model_path}", lambda: Encoder(model()))
        for batch in slices(batches, text, 2 << 20):
            got = [encoder.text(t) for t in batch.column(text).to_pylist()]
            offsets = np.cumsum([0] + [len(g) // 4 for g in got]).astype(np.int32)
            flat = np.frombuffer(b"".join(got), dtype=np.int32)
            columns = [batch.column(c) for c in keep]
            columns.append(pa.ListArray.from_arrays(offsets, flat))
            columns.append(pa.array(encoder.decoded(flat, offsets[1:]), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, ids, decoded])

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of what `encode` found."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
