"""Exact repeated substrings across documents, with suffix arrays built by linear grouping.

A byte goes if it is covered by a 50-byte string that also starts in a document with a smaller key.

1. Anchors. Of the 16-byte strings inside a window of 50 bytes, the one with the least hash is the
   window's anchor, so equal windows have equal anchors, wherever they stand. Consecutive windows
   with one anchor form a span. Only hashes of anchors and spans are shuffled, packed by bucket.
2. Spans equal to one in a smaller document go whole. Where different spans share an anchor, a
   repeat may begin or end inside. A window has 17 bytes or more to the left of its anchor or to the
   right, so only spans that agree, by hash, in the anchor and 17 bytes on one side can share one;
   their bytes are fetched.
3. Of these bytes, what no other span shares by window hash is trimmed away, equal rests are joined,
   and a suffix array over the rests brings equal windows together; they are compared byte by byte.
   Spans of an anchor that very many share do not meet: their windows become rows, the least
   document of each window's bytes is an aggregate, and it is joined to them.
4. Removed windows are gathered by document and cut out of its text.

Suffix arrays: suffixes are first grouped by their first byte. Groups are taken in descending order;
each member points to the nearest suffix to its left that lies in a lower group (previous smaller),
and suffixes pointed to move to a new group right behind their own, by how often they were pointed
to. In the end a group holds the suffixes with one Lyndon prefix. The order inside the groups then
follows from left to right through the same pointers, without any renaming or recursion.

Defined cases: a null text is empty; texts below 50 bytes lose nothing; rows without a key lose
nothing and take nothing from others; rows with equal keys never take from each other; an empty
table gives an empty table.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.llm.workers import slices
from creaseline.sources.storage import forget, written_alone

WINDOW = 50
ANCHOR = 16
BUCKET_BYTES = 8 << 20  # text whose anchors share a bucket
SIDE = (WINDOW - ANCHOR) // 2  # bytes on one side of its anchor, at least, that any window has
_PACK = 2_000_000  # anchors held before they are packed
_SUFFIXES = 1 << 15  # bytes sorted together
HOT_SPANS = 1 << 14  # different places of one anchor above which its windows are compared as rows
_SPANS = "id long, digest long, at int, more int"


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in ascending order; the last symbol must be the only smallest one."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    members = [by_symbol[symbol] for symbol in sorted(by_symbol)]
    lower, higher = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    group = [0] * n
    for g, suffixes in enumerate(members):
        for i in suffixes:
            group[i] = g
    left = list(range(-1, n))  # leads towards the nearest suffix in a lower group
    done, smaller = [False] * n, [-1] * n
    descending = []
    current = len(members) - 1
    while current >= 0:
        suffixes = members[current] = [i for i in members[current] if group[i] == current]
        descending.append(current)
        for i in suffixes:
            done[i] = True
        pointed: dict[int, int] = {}
        for i in suffixes:
            j, passed = left[i], [i]
            while j >= 0 and done[j]:
                passed.append(j)
                j = left[j]
            for k in passed:
                left[k] = j
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moving: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moving.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moving, reverse=True):
            new, above = len(members), higher[old]
            members.append(moving[times, old])
            for j in members[new]:
                group[j] = new
            lower.append(old)
            higher.append(above)
            higher[old] = new
            if above >= 0:
                lower[above] = new
        current = lower[current]
    start, at = [0] * len(members), 0
    for g in reversed(descending):
        start[g] = at
        at += len(members[g])
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    start[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            out[start[group[s]]] = s
            start[group[s]] += 1
            placed[s] = True
            s = smaller[s]
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; `data` has eight bytes to spare."""
    out = np.empty(len(data) - 8, dtype=np.uint64)
    for offset in range(8):
        part = out[offset::8]
        part[:] = np.frombuffer(data, dtype="<u8", count=len(part), offset=offset) if len(part) else 0
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= (b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(23)
    h += b * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sides(words: np.ndarray, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Hashes of each span's anchor with SIDE bytes to its left, and to its right; 0 if no window has them."""
    out = []
    for first, there in ((anchor - SIDE, anchor - lo >= SIDE), (anchor, anchor - hi <= WINDOW - ANCHOR - SIDE)):
        first = np.where(there, first, 0)
        h = np.zeros(len(first), dtype=np.uint64)
        for offset in (0, 8, 16, 24, SIDE + ANCHOR - 8):
            word = words[first + offset]
            h = _mixed(h ^ word, word + np.uint64(offset))
        out.append(np.where(there, (h >> np.uint64(32)) | np.uint64(1), np.uint64(0)))
    return out


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int], list[np.ndarray]]:
    """Text number, first window, number of further windows, anchor hash, span hash and side hashes of all spans."""
    joined = b"".join(texts)
    n = len(joined)
    empty = np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return empty, empty, empty, empty.astype(np.uint64), [], []
    words = _words(np.frombuffer(joined + bytes(24), dtype=np.uint8))
    value = _mixed(words[:n], words[8 : n + 8])
    index = np.arange(n, dtype=np.int32)
    reach = 1
    width = WINDOW - ANCHOR + 1
    while reach < width:
        step = min(reach, width - reach)
        later = value[step:] < value[:-step]
        index = np.where(later, index[step:], index[:-step])
        value = np.minimum(value[step:], value[:-step])
        reach += step
    ends = np.cumsum([len(t) for t in texts])
    valid = np.ones(n - WINDOW + 1, dtype=bool)
    crossing = (ends[:, None] - np.arange(1, WINDOW)).ravel()
    valid[crossing[(crossing >= 0) & (crossing < len(valid))]] = False
    windows = np.flatnonzero(valid)
    if not len(windows):
        return empty, empty, empty, empty.astype(np.uint64), [], []
    anchor = index[windows]
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    lo, hi = windows[first], windows[np.append(first[1:], len(windows)) - 1]
    owner = np.searchsorted(ends, lo, side="right")
    base = ends[owner] - np.array([len(t) for t in texts])[owner]
    digest = xxhash.xxh64_intdigest
    whole = [digest(joined[a:b]) for a, b in zip(lo.tolist(), (hi + WINDOW).tolist())]
    return owner, lo - base, hi - lo, value[lo], whole, _sides(words, anchor[first], lo, hi)


def _packed(parts: list, buckets: int) -> pa.RecordBatch:
    ids, digests, at, more, anchor, whole, left, right = (np.concatenate(p) for p in zip(*parts))
    bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names = np.unique(bucket)
    cuts = np.searchsorted(bucket[order], names)[1:]
    columns = [ids, digests, at.astype("<u4"), more.astype(np.uint8), anchor.astype("<u4"), whole, left.astype("<u4"), right.astype("<u4")]
    blobs = [[part.tobytes() for part in np.split(c[order], cuts)] for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(names), *[pa.array(b, pa.binary()) for b in blobs]],
        ["bucket", "ids", "digests", "at", "more", "anchors", "wholes", "lefts", "rights"],
    )


def _differing(anchor: np.ndarray, side: np.ndarray, whole: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether spans with the same anchor and side differ, and stand in more than one document."""
    there = np.flatnonzero(side)
    out = np.zeros(len(ids), dtype=bool)
    if not len(there):
        return out
    group = anchor[there].astype(np.uint64) << np.uint64(32) | side[there]
    order = np.argsort(group, kind="stable")
    place, group = there[order], group[order]
    new = np.append(True, group[1:] != group[:-1])
    begin = np.flatnonzero(new)
    several, apart = (
        np.minimum.reduceat(x[place], begin) < np.maximum.reduceat(x[place], begin) for x in (whole, ids)
    )
    out[place] = (several & apart)[np.cumsum(new) - 1]
    return out


def _repeated(table: pa.Table) -> pa.Table:
    """Spans of one bucket that occur in a smaller document (no anchor), and those to look at."""
    kinds = {"ids": "<i8", "digests": "<i8", "at": "<u4", "more": "u1", "anchors": "<u4", "wholes": "<u8", "lefts": "<u4", "rights": "<u4"}
    ids, digests, at, more, anchor, whole, left, right = (
        np.frombuffer(b"".join(table.column(n).to_pylist()), dtype=k) for n, k in kinds.items()
    )
    order = np.lexsort((ids, whole, anchor))
    ids, digests, at, more, anchor, whole, left, right = (c[order] for c in (ids, digests, at, more, anchor, whole, left, right))
    new_anchor = np.diff(anchor.astype(np.int64), prepend=-1) != 0
    new_whole = new_anchor | np.append(True, whole[1:] != whole[:-1])
    w = np.flatnonzero(new_whole)
    in_whole = np.cumsum(new_whole) - 1
    taken = ids > ids[w][in_whole]  # the least id comes first
    asked = ~taken & (_differing(anchor, left, in_whole, ids) | _differing(anchor, right, in_whole, ids))
    out = taken | asked
    name = np.where(asked, int(table.column("bucket")[0].as_py()) << 32 | anchor.astype(np.int64), -1)
    return pa.table({
        "id": ids[out], "digest": digests[out], "at": at[out].astype(np.int32), "more": more[out].astype(np.int32),
        "anchor": pa.array(name[out], mask=~asked[out]),
    })


def _window_hashes(joined: bytes, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at the positions."""
    words = _words(np.frombuffer(joined + bytes(8), dtype=np.uint8))
    h = np.zeros(len(at), dtype=np.uint64)
    for offset in (0, 8, 16, 24, 32, 40, WINDOW - 8):
        word = words[at + offset]
        h = _mixed(h ^ word, word + np.uint64(offset))
    return h


def shared_windows(anchors: list[int], ids: list[int], data: list[bytes]) -> list[list[tuple[int, int]]]:
    """Of each span, the runs (first window, further windows) that occur in a smaller document."""
    lengths = np.array([len(d) for d in data])
    many = lengths - WINDOW + 1
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hashes = _window_hashes(b"".join(data), np.repeat(np.cumsum(lengths) - lengths, many) + inner)
    counts = many.tolist()
    group = np.repeat(np.unique(anchors, return_inverse=True)[1], counts)
    owner = np.repeat(np.array(ids), counts)
    order = np.lexsort((owner, hashes, group))
    same = (hashes[order][1:] == hashes[order][:-1]) & (group[order][1:] == group[order][:-1])
    begin = np.flatnonzero(np.append(True, ~same))
    size = np.diff(np.append(begin, len(order)))
    low, high = owner[order][begin], owner[order][begin + size - 1]
    shared = np.zeros(len(hashes), dtype=bool)
    shared[order] = np.repeat(low < high, size)
    # Trim each span to what it may share; equal rests of one anchor are one.
    rests: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    span_of, place_in = np.repeat(np.arange(len(data)), many)[shared], inner[shared]
    firsts = np.flatnonzero(np.diff(span_of, prepend=-1))
    lasts = np.append(firsts[1:], len(span_of)) - 1
    for n, a, b in zip(span_of[firsts].tolist(), place_in[firsts].tolist(), place_in[lasts].tolist()):
        rests.setdefault((anchors[n], data[n][a : b + WINDOW]), []).append((n, a))
    keys = sorted(rests)
    least = [min(ids[n] for n, _ in rests[k]) for k in keys]
    first_with: list[list[int]] = [[0] * (len(k[1]) - WINDOW + 1) for k in keys]
    held, size = [], 0
    for n, (name, rest) in enumerate(keys):
        held.append(n)
        size += len(rest) + 1
        if n + 1 == len(keys) or (size > _SUFFIXES and keys[n + 1][0] != name):
            _least_ids(held, keys, least, first_with)
            held, size = [], 0
    out: list[list[tuple[int, int]]] = [[] for _ in data]
    for key, found in zip(keys, first_with):
        for n, offset in rests[key]:
            runs = out[n]
            for at, first in enumerate(found, offset):
                if first < ids[n]:
                    if runs and sum(runs[-1]) + 1 == at:
                        runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                    else:
                        runs.append((at, 0))
    return out


def _least_ids(held: list[int], keys: list, least: list[int], first_with: list[list[int]]) -> None:
    """For each window of the rests, the least id of a span that has it, by their suffix array."""
    text, place = [], []
    for n in held:
        rest = keys[n][1]
        windows = len(rest) - WINDOW + 1
        text += [b + 2 for b in rest] + [1]
        place += [(n, i) for i in range(windows)] + [None] * WINDOW
    text.append(0)
    place.append(None)
    run: list[tuple[int, int]] = []
    string = None
    for suffix in suffix_array(text):
        if place[suffix] is None:
            continue
        n, i = place[suffix]
        now = keys[n][1][i : i + WINDOW]
        if now != string:
            _settle(run, least, first_with)
            run, string = [], now
        run.append((n, i))
    _settle(run, least, first_with)


def _settle(run: list[tuple[int, int]], least: list[int], first_with: list[list[int]]) -> None:
    smallest = min((least[n] for n, _ in run), default=0)
    for n, i in run:
        first_with[n][i] = smallest


def removed_windows(docs: DataFrame) -> DataFrame:
    """(id, digest, at, more): runs of windows of each document that go; docs has id, digest, text."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, total // BUCKET_BYTES)

    def anchor(batches):
        parts, held = [], 0
        for batch in slices(batches, "text", 2 << 20):
            texts = [t.encode("utf-8") for t in batch.column("text").to_pylist()]
            owner, at, more, hashes, whole, sides = spans(texts)
            if len(owner):
                ids, digests = batch.column("id").to_numpy(), batch.column("digest").to_numpy()
                parts.append((ids[owner], digests[owner], at, more, hashes, np.array(whole, dtype=np.uint64), *sides))
                held += len(owner)
            if held > _PACK:
                yield _packed(parts, buckets)
                parts, held = [], 0
        if parts:
            yield _packed(parts, buckets)

    blobs = "bucket long, ids binary, digests binary, at binary, more binary, anchors binary, wholes binary, lefts binary, rights binary"
    found = docs.mapInArrow(anchor, blobs).groupBy("bucket").applyInArrow(_repeated, f"{_SPANS}, anchor long")
    found = written_alone(found, "repeated-spans")

    def fetch(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out = [
                (i, d, span["at"], span["anchor"], text[span["at"] : span["at"] + span["more"] + WINDOW])
                for i, d, zipped, asked in zip(rows["id"], rows["digest"], rows["packed"], rows["asked"])
                for text in [zlib.decompress(zipped)] for span in asked
            ]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "digest", "at", "anchor", "data"])

    def compare(table):
        rows = table.to_pydict()
        runs = shared_windows(rows["anchor"], rows["id"], rows["data"])
        out = [(i, d, at + a, m) for i, d, at, own in zip(rows["id"], rows["digest"], rows["at"], runs) for a, m in own]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], ["id", "digest", "at", "more"])

    def fetched(spans_):
        asked = spans_.groupBy("id", "digest").agg(F.collect_list(F.struct("at", "more", "anchor")).alias("asked"))
        rows = packed(docs).join(asked, ["id", "digest"])
        return rows.mapInArrow(fetch, "id long, digest long, at int, anchor long, data binary")

    asked = found.filter("anchor IS NOT NULL")
    hot = written_alone(asked.groupBy("anchor").count().filter(F.col("count") > HOT_SPANS).select("anchor"), "hot-anchors")
    some = not hot.isEmpty()
    parts = fetched(asked)
    if some:
        parts = written_alone(parts, "asked-spans")  # texts are shuffled once for both kinds
    rest = (parts.join(hot, "anchor", "left_anti") if some else parts).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    edges = rest.groupBy("part").applyInArrow(compare, _SPANS)
    if some:
        edges = edges.union(repeated_windows(parts.join(hot, "anchor", "left_semi")))
    whole = found.filter("anchor IS NULL").select("id", "digest", "at", "more")
    runs = written_alone(whole.union(edges), "repeated-windows")
    forget(found, *([parts] if some else []))
    return runs


def repeated_windows(fetched: DataFrame) -> DataFrame:
    """(id, digest, at, more): windows of the spans (id, digest, at, data) that a smaller document has."""
    places = F.posexplode(F.expr(f"transform(sequence(0, octet_length(data) - {WINDOW}), i -> substr(data, i + 1, {WINDOW}))"))
    windows = fetched.select("id", "digest", "at", places.alias("further", "window"))
    ends = windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    repeated = windows.join(ends, "window").filter("id > least")
    return repeated.select("id", "digest", (F.col("at") + F.col("further")).cast("int").alias("at"), F.lit(0).alias("more"))


def packed(docs: DataFrame) -> DataFrame:
    """(id, digest, packed): texts compressed before they are shuffled."""
    def pack(batches):
        for batch in slices(batches, "text"):
            texts = pa.array([zlib.compress((t or "").encode("utf-8"), 1) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), texts], ["id", "digest", "packed"])

    return docs.select("id", "digest", "text").mapInArrow(pack, "id long, digest long, packed binary")


def cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Bytes and maximal spans that runs of windows cover."""
    merged: list[list[int]] = []
    for begin, end in sorted((at, at + more + WINDOW) for at, more in runs):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    return sum(b - a for a, b in merged), [(a, b) for a, b in merged]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_bytes, kept (the remaining bytes), n_removed, n_spans, spans (begin, end)."""
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("digest", F.xxhash64("text"))
    runs = removed_windows(rows.filter("id IS NOT NULL AND octet_length(text) >= 50"))
    gathered = runs.groupBy(F.col("id").alias("run_id"), F.col("digest").alias("run_digest")).agg(
        F.collect_list(F.struct("at", "more")).alias("runs")
    )
    joined = packed(rows).join(gathered, (F.col("id") == F.col("run_id")) & (F.col("digest") == F.col("run_digest")), "left")

    def finish(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for zipped, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = zlib.decompress(zipped)
                removed, gone = cut(data, [(r["at"], r["more"]) for r in own or ()])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                out.append((len(data), b"".join([*kept, data[at:]]), removed, len(gone), [{"begin": a, "end": b} for a, b in gone]))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds)]], [key, "n_bytes", "kept", "n_removed", "n_spans", "spans"])

    schema = f"`{key}` long, n_bytes long, kept binary, n_removed long, n_spans long, spans array<struct<begin:int,end:int>>"
    return joined.select("id", "packed", "runs").mapInArrow(finish, schema)
