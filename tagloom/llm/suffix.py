"""Removal of long byte strings that occur earlier, by sorted suffixes.

Every string of `length` bytes (a window) is judged, yet only some suffixes are
sorted.  A window's anchor is its k-gram with the least hash, so equal windows have
equal anchors in equal places, and neighbouring windows share an anchor.  The steps:

1. Anchors are found with rolling hashes; their hashes are exchanged, packed, and those
   that occur once are dropped: no window around them can repeat.  (Distinguishing
   prefixes are approximated alike in distributed string sorting.)  K-grams that a
   sample of documents shows to be frequent are anchors only where a window has no
   other, so a line that stands everywhere does not gather its neighbourhoods.
2. The remaining anchors' suffixes are cut from their texts.  Each task sorts its own,
   keeps one of those equal in their whole surroundings (the others repeat it and are
   reported at once), and sends the rest as front-coded runs: each suffix as the length
   of the prefix it shares with the one before, and its other bytes.  Suffixes are
   dealt by their k-gram, so all that can be equal meet.
3. The runs are merged by a loser tree that holds for each head the common prefix with
   the last winner.  Heads with different such lengths are ordered without looking at
   their bytes; equal ones compare only beyond it.  The merge yields the suffixes in
   order and the common prefix of neighbours.
4. For each place of the anchor inside a window, the windows' later parts are equal
   where the common prefixes reach far enough, and their earlier parts where the
   backward strings, sorted likewise, do.  All but the first in (doc_id, start) repeat.

All comparisons that decide are of bytes; hashes only rule out.  Texts are dealt once,
by row, and that exchange serves both joins.

Cases: a null text is empty; texts shorter than a window lose nothing; very long texts
are cut into overlapping pieces, so a task's arrays stay small; rows equal in doc_id
and text are one document and each get its result; a null id comes first; rows that
share an id but not a text are ordered by a hash; an empty table gives no rows; extra
columns are ignored; ids must be integers, and strings have 255 bytes at most (an
error otherwise).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import text_of

LENGTH, GRAM, PIECE = 100, 32, 1 << 20
_LOW = np.uint64((1 << 24) - 1)
#: An anchor: its k-gram's hash, its document, its place, and the windows around it as
#: the least and greatest distance from a window's start to the anchor.
ANCHOR = np.dtype([("h", "<u8"), ("id", "<i8"), ("row", "<i8"), ("at", "<i8"), ("near", "u1"), ("far", "u1")])
_FIELDS = ("h", "id", "row", "at", "near", "far")
_NO_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random words for bytes, and powers of an odd base and of its inverse."""
    rng = np.random.default_rng(7)
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    power = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64)
    return rng.integers(0, 1 << 64, 256, np.uint64), power(np.uint64(base)), power(np.uint64(inverse))


def find_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, frequent: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """text number, place, near, far and hash of the anchors of all windows.  frequent:
    ascending hashes of k-grams that are anchors only where there is no other."""
    parts: list[tuple[int, int, bytes]] = []
    out: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if parts:
            out.append(_anchors(parts, length, gram, frequent))
        parts.clear()
        size = 0

    for number, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, PIECE):
            piece = text[start : start + PIECE + length - 1]
            parts.append((number, start, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(map(np.concatenate, zip(*out)))


def _anchors(parts: list[tuple[int, int, bytes]], length: int, gram: int, frequent: np.ndarray | None) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    sizes = np.array([len(p) for _, _, p in parts], np.int64)
    ends = np.cumsum(sizes)
    words, power, inverse = _tables(4 * PIECE)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words[data] * power[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    wide = length - gram + 1
    key = (h >> np.uint64(1) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    if frequent is not None and len(frequent):
        place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        key |= (frequent[place] == h).astype(np.uint64) << np.uint64(63)
    padded = np.full(-(-len(key) // wide) * wide, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
    start = np.flatnonzero(np.repeat(ends, sizes)[:windows] - np.arange(windows) >= length)
    at = (least[start] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[first[1:], len(at)] - 1
    at, low, high = at[first], start[first], start[last]
    part = np.searchsorted(ends, low, "right")
    shift = np.array([s for _, s, _ in parts], np.int64)[part] - (ends - sizes)[part]
    return np.array([k for k, _, _ in parts], np.int64)[part], at + shift, at - high, at - low, h[at]


def _pack(anchors: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(b"".join(np.ascontiguousarray(anchors[f]).tobytes() for f in _FIELDS), 1)


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    data = zstandard.decompress(blob)
    n = len(data) // ANCHOR.itemsize
    out, at = np.zeros(n, ANCHOR), 0
    for f in _FIELDS:
        size = n * ANCHOR[f].itemsize
        out[f] = np.frombuffer(data[at : at + size], ANCHOR[f])
        at += size
    return out


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For each of the sorted suffixes, the length of the prefix it shares with the one
    before, and what follows."""
    shared, rest, last = [], [], b""
    for s in suffixes:
        k = common(last, s, 0)
        shared.append(k)
        rest.append(s[k:])
        last = s
    return shared, rest


def common(a: bytes, b: bytes, k: int) -> int:
    """The length of the common prefix, if the first k bytes are known to agree."""
    n = min(len(a), len(b))
    while k < n and a[k : k + 16] == b[k : k + 16]:
        k += 16
    if k >= n:
        return n
    while k < n and a[k] == b[k]:
        k += 1
    return k


class Run:
    """A front-coded run, read from its start."""

    __slots__ = ("shared", "rest", "next", "head", "lcp")

    def __init__(self, shared: list[int], rest: list[bytes]):
        self.shared, self.rest, self.next, self.head, self.lcp = shared, rest, 0, b"", 0
        self.step()

    def step(self) -> None:
        if self.next < len(self.rest):
            self.lcp = self.shared[self.next]
            self.head = self.head[: self.lcp] + self.rest[self.next]
            self.next += 1
        else:
            self.head = None


def merged(runs: list[Run]) -> Iterator[tuple[int, int, bytes]]:
    """run, common prefix with the one before, and suffix, in order: a loser tree.

    Every loser keeps the common prefix with the head that beat it.  When a winner
    leaves, that is the common prefix with the last winner for all it meets on its way
    down, so a game between heads with different lengths is decided by them."""
    k = 1
    while k < len(runs):
        k *= 2
    size = len(runs)
    lcp = [0] * k
    heads: list[bytes | None] = [r.head for r in runs] + [None] * (k - size)

    def beats(a: int, b: int) -> bool:
        """Whether a goes before b; the loser's lcp is then with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        at = common(x, y, lcp[a])
        first = len(x) == at and (len(y) > at or a < b) or at < min(len(x), len(y)) and x[at] < y[at]
        lcp[b if first else a] = at
        return first

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1]
    while heads[top] is not None:
        yield top, lcp[top], heads[top]
        run = runs[top]
        run.step()
        heads[top], lcp[top] = run.head, run.lcp
        node = (top + k) >> 1
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node >>= 1


def repeats(lcp: np.ndarray, back: np.ndarray, info: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted suffixes with their common prefixes and backward strings (rows of
    bytes, padded): which have repeated windows, and their least and greatest distance."""
    n = len(info)
    order = np.lexsort((info["near"], info["at"], info["row"], info["id"]))
    sorted_ = info[order]
    same = np.logical_and.reduce([sorted_[f][1:] == sorted_[f][:-1] for f in ("id", "row", "at", "near", "far")])
    order = order[np.r_[True, ~same]]  # a row that comes twice is one document
    by = np.argsort(back.view(f"S{back.shape[1]}").ravel(), kind="stable")
    differ = back[by][1:] != back[by][:-1]
    reach = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), back.shape[1])]
    low, high = np.full(n, 255, np.int64), np.full(n, -1, np.int64)
    behind = np.empty(n, np.int64)
    near, far = info["near"].astype(np.int64), info["far"].astype(np.int64)
    for o in range(int(near.min()), int(far.max()) + 1):
        ahead = np.cumsum(lcp < length - o)
        behind[by] = np.cumsum(reach < o)
        own = order[((near <= o) & (o <= far))[order]]  # in (doc_id, start) order
        if len(own) < 2:
            continue
        kind = ahead[own] * (n + 1) + behind[own]
        again = np.ones(len(own), bool)
        again[np.unique(kind, return_index=True)[1]] = False
        x = own[again]
        low[x] = np.minimum(low[x], o)
        high[x] = np.maximum(high[x], o)
    hit = np.flatnonzero(high >= 0)
    return hit, low[hit], high[hit]


_COVER = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("cover", pa.int64())])
_RUN = pa.schema([("bucket", pa.int32()), *_COVER, ("run", pa.binary())])


def _covers(info: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> pa.RecordBatch:
    """A cover is a start << 16 | a number of bytes."""
    cover = info["at"] - high << 16 | high - low + length
    return pa.RecordBatch.from_arrays([pa.array(info["id"]), pa.array(info["row"]), pa.array(cover)], schema=_COVER)


def _encode_run(suffixes: list[tuple[bytes, bytes, np.void]]) -> bytes:
    import zstandard

    shared, rest = front_code([s for s, _, _ in suffixes])
    info = np.array([i for _, _, i in suffixes], ANCHOR)
    parts = [
        np.array([len(suffixes)], "<u4").tobytes(),
        np.array(shared, "u1").tobytes(),
        np.array([len(r) for r in rest], "u1").tobytes(),
        np.array([len(b) for _, b, _ in suffixes], "u1").tobytes(),
        *[np.ascontiguousarray(info[f]).tobytes() for f in _FIELDS],
        *rest,
        *[b for _, b, _ in suffixes],
    ]
    return zstandard.compress(b"".join(parts), 1)


def _decode_run(blob: bytes) -> tuple[Run, list[bytes], np.ndarray]:
    import zstandard

    data = zstandard.decompress(blob)
    n, at = int(np.frombuffer(data[:4], "<u4")[0]), 4
    shared, rests, backs = (np.frombuffer(data, "u1", n, at + k * n).tolist() for k in range(3))
    at += 3 * n
    info = np.zeros(n, ANCHOR)
    for f in _FIELDS:
        info[f] = np.frombuffer(data, ANCHOR[f], n, at)
        at += n * ANCHOR[f].itemsize

    def cut(sizes: list[int]) -> list[bytes]:
        nonlocal at
        out = []
        for size in sizes:
            out.append(data[at : at + size])
            at += size
        return out

    rest = cut(rests)
    return Run(shared, rest), cut(backs), info


def frequent_grams(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sample: int = 20_000, share: float = 0.002) -> np.ndarray:
    """Ascending hashes of anchors that stand in more than that share of about `sample`
    documents.  They only route suffixes; results do not depend on them.  There are at
    most the sample's anchors times 1 / (share * sample): tens of thousands."""
    n = docs.count()
    some = docs.where(F.pmod("row", F.lit(max(1, n // sample))) == 0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, _, _, _, h = find_anchors(batch.column(0).cast(pa.binary()).to_pylist(), length, gram)
            once = np.unique(np.stack([which.astype(np.uint64), h]), axis=1)[1] if len(h) else h
            each, count = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(count)], ["h", "n"])

    least = max(10, int(share * min(n, sample)))
    rows = some.select("text").mapInArrow(hashed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: np.ndarray | None = None) -> DataFrame:
    """id, row, cover: bytes of texts (id, row, text) that an earlier equal string of
    `length` bytes repeats; ranges may overlap."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    wide = max(1, length - gram)
    known = spark.sparkContext.broadcast(frequent_grams(docs, length, gram) if frequent is None else frequent)  # see there

    def named(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        return batch.column("id").to_numpy(), batch.column("row").to_numpy(), batch.column("text").cast(pa.binary()).to_pylist()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts = named(batch)
            which, at, near, far, h = find_anchors(texts, length, gram, known.value)
            found = np.zeros(len(at), ANCHOR)
            found["h"], found["id"], found["row"], found["at"], found["near"], found["far"] = h, ids[which], rows[which], at, near, far
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, bucket = found[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            blobs = [_pack(found[i:j]) for i, j in zip(cuts, [*cuts[1:], len(found)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(bucket, []).append(blob)
        for bucket in list(by):
            found = np.concatenate([_unpack(b) for b in by.pop(bucket)])
            found = found[np.argsort(found["h"], kind="stable")]
            same = np.r_[False, found["h"][1:] == found["h"][:-1], False]
            found = found[same[1:] | same[:-1]]
            spot = found["at"] << 16 | found["near"].astype(np.int64) << 8 | found["far"]
            yield pa.RecordBatch.from_arrays([pa.array(found["id"]), pa.array(found["row"]), pa.array(spot)], ["id", "row", "spot"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        held: dict[int, list[tuple[bytes, bytes, tuple]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out, again = [], []
            for bucket, each in held.items():
                each.sort()
                run = []
                for s in each:
                    if run and s[:2] == run[-1][:2] and s[2][4:] == run[-1][2][4:]:
                        if s[2] != run[-1][2]:  # the same row twice is one document
                            again.append(s[2])
                    else:
                        run.append(s)
                out.append((bucket, run))
            for at in range(0, len(out), 200):
                part = out[at : at + 200]
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int32()), none, none, none, pa.array([_encode_run(r) for _, r in part], pa.binary())], schema=_RUN)
            info = np.array(again, ANCHOR)
            cover = _covers(info, info["near"].astype(np.int64), info["far"].astype(np.int64), length)
            # reported ranges are dealt by row number: nothing gathers them
            spread = pa.array((info["row"] % buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([spread, *cover.columns, pa.array([None] * len(info), pa.binary())], schema=_RUN)
            held.clear()

        for batch in batches:
            ids, rows, texts = named(batch)
            spots = batch.column("spots")
            offsets = spots.offsets.to_numpy()
            spot = spots.values.to_numpy()
            at, near, far = spot >> 16, spot >> 8 & 255, spot & 255
            for k, text in enumerate(texts):
                doc, row = int(ids[k]), int(rows[k])
                i, j = offsets[k], offsets[k + 1]
                for p, o, q in zip(at[i:j].tolist(), near[i:j].tolist(), far[i:j].tolist()):
                    ahead = text[p : p - o + length]
                    info = (0, doc, row, p, o, q)
                    held.setdefault(xxh64_intdigest(ahead[:gram]) % buckets, []).append((ahead, text[p - q : p][::-1], info))
                    size += 400
                if size > 128 << 20:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            mine = batch.filter(batch.column("run").is_null())
            if len(mine):
                yield mine.select(["id", "row", "cover"])
            mine = batch.filter(batch.column("run").is_valid())
            for bucket, blob in zip(mine.column("bucket").to_pylist(), mine.column("run").to_pylist()):
                by.setdefault(bucket, []).append(blob)
        for bucket in list(by):
            heads, backs, infos = zip(*map(_decode_run, by.pop(bucket)))
            taken = [0] * len(heads)
            lcps: list[int] = []
            back: list[bytes] = []
            info: list = []

            def judged() -> Iterator[pa.RecordBatch]:
                if len(info) > 1:
                    rows = np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in back), np.uint8).reshape(-1, wide)
                    each = np.array(info, ANCHOR)
                    hit, low, high = repeats(np.array(lcps), np.ascontiguousarray(rows), each, length)
                    if len(hit):
                        yield _covers(each[hit], low, high, length)
                lcps.clear(), back.clear(), info.clear()

            for run, lcp, _ in merged(list(heads)):
                if lcp < gram and len(info) > 20_000:
                    yield from judged()
                k = taken[run]
                taken[run] += 1
                lcps.append(lcp)
                back.append(backs[run][k])
                info.append(infos[run][k])
            yield from judged()

    once = docs.select("id", "row", "text")
    # with doc_id, which nothing here reads, the texts' exchange is that of dedup_suffixes
    hashes = once.where(F.length("text") >= length // 4).mapInArrow(hashed, "bucket int, blob binary")
    anchors = hashes.repartition(parts, "bucket").mapInArrow(repeated, "id long, row long, spot long")
    spots = anchors.groupBy(F.col("id").alias("spot_id"), F.col("row").alias("spot_row")).agg(F.collect_set("spot").alias("spots"))
    held = docs.join(spots, (F.col("id") == F.col("spot_id")) & (F.col("row") == F.col("spot_row"))).select(*docs.columns, "spots")
    sent = held.mapInArrow(runs, "bucket int, id long, row long, cover long, run binary")
    return sent.repartition(parts, "bucket").mapInArrow(merge, "id long, row long, cover long")


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal ranges that sorted ones cover."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, full: bool = True, frequent: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if full also spans (removed
    ranges) and kept (the remaining bytes), for every row of docs."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer: earlier means a smaller one")
    if not gram <= length <= 255:
        raise ValueError("strings have 255 bytes at most, and no fewer than a k-gram")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long"))
    texts = docs.select("doc_id", number.alias("id"), F.xxhash64("doc_id", "text").alias("row"), text_of().alias("text"))
    ranges = covered(texts, length, gram, frequent)
    ranges = ranges.groupBy(F.col("id").alias("cut_id"), F.col("row").alias("cut_row")).agg(F.collect_set("cover").alias("cuts"))
    joined = texts.join(ranges, (F.col("id") == F.col("cut_id")) & (F.col("row") == F.col("cut_row")), "left").select("doc_id", "id", "row", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            spans, kept = [], []
            for text, cuts in zip(texts, batch.column("cuts").to_pylist()):
                found = union([(c >> 16, (c >> 16) + (c & 65535)) for c in cuts or ()])
                ends = [0, *[x for span in found for x in span], len(text)]
                spans.append(found)
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
            sizes = pa.array(map(len, texts), pa.int64())
            gone = pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64())
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            columns = [batch.column("doc_id"), sizes, gone, pa.array(map(len, spans), pa.int64()), digests]
            if full:
                shown = [[{"low": a, "high": b} for a, b in s] for s in spans]
                columns += [pa.array(shown, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", spans array<struct<low:bigint,high:bigint>>, kept binary" if full else ""
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
