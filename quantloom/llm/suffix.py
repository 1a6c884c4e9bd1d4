"""Repeated byte strings by enhanced suffix arrays over anchored frames (operator 5).

Every window of ``length`` bytes has an anchor: its least gram of ``GRAM``
bytes by hash, the leftmost of equals. Equal windows have equal anchors at
equal places, so windows need to be compared only within the frames of one
anchor; a frame is the text under all windows of a document that share one
anchor occurrence, at most 2 * length - GRAM bytes.

1. Anchors that occur once are dropped by a count. Equal frames of an anchor
   are one, with their number; a frame that occurs twice is repeated wholly.
2. Anchors with several different frames get an enhanced suffix array over
   their frames: suffixes sorted by prefix doubling, the array of longest
   common prefixes, and a stack scan of it that builds the tree of
   common-prefix intervals. An interval of ``length`` or more whose suffixes
   have different left neighbours is a maximal repeat with all its occurrences.
3. Anchors with very many different frames are split before that: windows are
   dealt in bands by their distance from the anchor and by the bytes that all
   windows of the band share, and in the last resort one by one.

Frames bound the repeats: one longer than a frame comes out as overlapping
groups of neighbouring anchors, whose spans join in repeated_spans().

Defined cases: a null text is empty; texts under ``length`` bytes have no
repeats; rows that repeat a doc_id are documents of their own, and when they
repeat its text too, all of it is repeated; a null doc_id is a document like
others; a text of any length is taken whole, in overlapping segments; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import stash

LENGTH, GRAM = 200, 32
#: Different frames of one anchor that one task takes together.
TOGETHER = 1024
#: Window starts in a band of a split anchor.
BAND = 16
_SEGMENT = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)


def frames(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, first start, number of starts, anchor's distance, anchor hash and frame hash of a chunk under 16 MB."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return (none,) * 6
    h = X.rolling_hash(data, gram)
    key = (h & ~_PLACE) | np.arange(n - gram + 1, dtype=np.uint64)
    w = length - gram + 1
    # the least key of every w neighbours, from minima within rows of w
    rows = np.concatenate((key, np.full(-len(key) % w, ~np.uint64(0)))).reshape(-1, w)
    fore = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    least = (np.minimum(back[:m], fore[w - 1 : w - 1 + m]) & _PLACE).astype(np.int64)
    change = np.zeros(n + 1, np.int64)
    has = np.diff(offs) >= length
    np.add.at(change, offs[:-1][has], 1)
    np.add.at(change, offs[1:][has] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(change)[:m] > 0)
    if not len(starts):
        return (none,) * 6
    anchor = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    a = starts[first]
    count = np.diff(np.append(first, len(starts)))
    anchor = anchor[first]
    doc = np.searchsorted(offs, a, "right") - 1
    frame = X.span_hash(data, a, a + count - 1 + length)
    return doc, a - offs[doc], count, anchor - a, h[anchor].view(np.int64), frame.view(np.int64)


def _parts(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, place of the first byte) of a chunk; one long text in segments that share length - 1 bytes."""
    if len(data) <= _SEGMENT:
        yield data, offs, 0
        return
    for s in range(0, len(data), _SEGMENT):
        part = data[s : s + _SEGMENT + length - 1]
        yield part, np.array([0, len(part)]), s


def _cut(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in X.chunks(b.column("text")):
                for part, own, base in _parts(data, offs, length):
                    doc, a, n, far, anchor, frame = frames(part, own, length, gram)
                    if len(doc):
                        take = pa.array(doc + i)
                        place = ((a + base) << 24) | (n << 12) | far
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), pa.array(anchor), pa.array(frame), pa.array(place)], names=["doc_id", "th", "anchor", "frame", "place"])
            X.trim()

    return run


def enhanced(texts: list[bytes], counts: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The enhanced suffix array of the window starts of several texts.

    counts: window starts at the head of each text. Returns the sorted
    suffixes' texts, their starts, the longest common prefix with the one
    before, and the symbol to the left (0 at a text's head).
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    till = np.repeat(ends, sizes)  # where the text of each place ends
    here = np.arange(n)
    base = 7  # symbols in the first ranks, 9 bits each; 0 stands for what lies after the end
    padded = np.concatenate((data.astype(np.int64) + 1, np.zeros(base, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(base):
        key = (key << 9) | np.where(here + k < till, padded[k : k + n], 0)
    levels, depth = [], base
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    levels.append((depth, rank))
    longest = int(sizes.max()) if len(sizes) else 0
    while depth < longest:
        ahead = here + depth
        follow = np.where(ahead < till, np.concatenate((rank, np.zeros(depth, np.int64)))[depth : depth + n], 0)
        rank = np.unique((rank << 32) | follow, return_inverse=True)[1].astype(np.int64) + 1
        depth *= 2
        levels.append((depth, rank))
    heads = ends - sizes
    counts = np.asarray(counts, np.int64)
    which = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = heads[which] + starts
    order = np.argsort(rank[place], kind="stable")
    place, which, starts = place[order], which[order], starts[order]
    x, y = place[:-1].copy(), place[1:].copy()
    lcp = np.zeros(len(place), np.int64)
    run = np.zeros(len(x), np.int64)
    limit = np.minimum(till[x] - x, till[y] - y) if len(x) else run
    for size, r in reversed(levels[:-1] if len(levels) > 1 else levels):
        for _ in range(2 if size > base else 2):
            ok = run + size <= limit
            px, py = np.minimum(x + run, n - 1), np.minimum(y + run, n - 1)
            run = run + np.where(ok & (r[px] == r[py]), size, 0)
    for _ in range(base):
        ok = run < limit
        px, py = np.minimum(x + run, n - 1), np.minimum(y + run, n - 1)
        run = run + (ok & (data[px] == data[py]))
    lcp[1:] = run
    left = np.where(starts > 0, data[np.maximum(place - 1, 0)].astype(np.int64) + 1, 0)
    return which, starts, lcp, left


def intervals(lcp: np.ndarray, left: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(first, last + 1, depth) of the common-prefix intervals of depth ``length`` or more with different left symbols.

    One scan with a stack. Each open interval keeps the one left symbol of its suffixes, or -1 for several.
    """
    big = lcp >= length
    edge = np.flatnonzero(np.diff(np.concatenate(([0], big.view(np.int8), [0]))))
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # suffixes lo - 1 .. hi - 1 share length symbols or more
        depths, lefts = lcp[lo:hi].tolist(), left[lo - 1 : hi].tolist()
        stack: list[list[int]] = []  # depth, first suffix, left symbol
        carry = lefts[0] or -1
        for k, d in enumerate([*depths, 0]):
            first = lo - 1 + k
            symbol = carry
            while stack and stack[-1][0] > d:
                depth, first, own = stack.pop()
                symbol = own if own == symbol else -1
                if symbol == -1:
                    yield first, lo + k, depth
            if d:
                if stack and stack[-1][0] == d:
                    if stack[-1][2] != symbol:
                        stack[-1][2] = -1
                else:
                    stack.append([d, first, symbol])
                carry = lefts[k + 1] or -1


def _fold(frames_of: list[bytes], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """The merged spans of each text under the occurrences of maximal repeats of the texts together."""
    which, starts, lcp, left = enhanced(frames_of, counts, length)
    deep = np.zeros(len(which), np.int64)  # the longest maximal repeat at each suffix
    for first, last, depth in intervals(lcp, left, length):
        part = deep[first:last]
        np.maximum(part, depth, out=part)
    hit = np.flatnonzero(deep)
    spans: list[list[tuple[int, int]]] = [[] for _ in frames_of]
    order = hit[np.lexsort((starts[hit], which[hit]))]
    for t, a, e in zip(which[order].tolist(), starts[order].tolist(), (starts[order] + deep[order]).tolist(), strict=True):
        own = spans[t]
        if own and a <= own[-1][1]:
            if e > own[-1][1]:
                own[-1] = (own[-1][0], e)
        else:
            own.append((a, e))
    return spans


def maximal_repeats(texts: list[bytes], length: int = LENGTH) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """The maximal repeats of whole texts, each with all its occurrences (text, start), by one enhanced suffix array."""
    counts = [max(0, len(t) - length + 1) for t in texts]
    if not any(counts):
        return []
    which, starts, lcp, left = enhanced(texts, counts, length)
    out = []
    for first, last, depth in intervals(lcp, left, length):
        places = sorted(zip(which[first:last].tolist(), starts[first:last].tolist(), strict=True))
        t, a = places[0]
        out.append((texts[t][a : a + depth], places))
    return out


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, a, e): covered bytes a..e of texts; th is the text's hash. Spans may overlap."""
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = _repeated(docs, kind, length, gram)
    at, n = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(4095)
    one = F.min(F.struct("doc_id", "th", "place"))
    c = stash(found.groupBy("anchor", "frame").agg(F.count(F.lit(1)).alias("c"), F.max("mixed").alias("mixed"), one.alias("r")).filter("mixed or c > 1").select("anchor", "frame", "c", "mixed", "r.*"), "frames")
    # frames that occur twice or more are covered wholly, wherever they are
    twice = c.filter("c > 1").select("anchor", "frame")
    whole = found.join(twice, ["anchor", "frame"]).select("doc_id", "th", at.alias("a"), (at + n + (length - 1)).alias("e"))
    crowd = c.filter("mixed").groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd"))
    asked = c.filter("mixed").join(crowd, "anchor").select("doc_id", "th", "anchor", "c", "crowd", "place")
    fetched = _fetch(docs, asked, kind, length)
    # a frame of an anchor with few others
    small = _compare(fetched.filter(F.col("crowd") <= TOGETHER), kind, length)
    split = _split(fetched.filter(F.col("crowd") > TOGETHER), kind, length)
    return whole.unionByName(small).unionByName(split)


def _repeated(docs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """The frames of anchors that occur more than once; mixed: with different frames."""
    cut = docs.mapInArrow(_cut(length, gram), f"doc_id {kind}, th long, anchor long, frame long, place long")
    twice = stash(cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("frame").alias("x"), F.max("frame").alias("y")).filter("c > 1").select("anchor", (F.col("x") != F.col("y")).alias("mixed")), "anchors")
    return stash(cut.join(twice, "anchor"), "repeated")


def packed(docs: DataFrame, kind: str) -> DataFrame:
    """Texts compressed one by one, for a shuffle that is half as large."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [pack.compress(x.as_buffer()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(z, pa.binary())], names=["doc_id", "th", "z"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, z binary")


def _fetch(docs: DataFrame, asked: DataFrame, kind: str, length: int) -> DataFrame:
    """asked with the frames' bytes; a document's requests meet its text once."""
    per_doc = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "c", "crowd", "place")).alias("asked"))
    texts = packed(docs, kind).dropDuplicates(["doc_id", "th"])
    both = per_doc.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "h").join(texts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("doc_id", "th", "asked", "z")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            doc, cols = [], {k: [] for k in ("anchor", "c", "crowd", "place")}
            frame, size = [], 0
            for k, (asks, z) in enumerate(zip(b.column("asked").to_pylist(), b.column("z"), strict=True)):
                raw = unpack.decompress(z.as_buffer())
                for x in asks:
                    at, n = x["place"] >> 24, (x["place"] >> 12) & 4095
                    doc.append(k)
                    frame.append(raw[at : at + n + length - 1])
                    for c in cols:
                        cols[c].append(x[c])
                size += len(asks)
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), *(pa.array(v, pa.int64()) for v in cols.values()), pa.array(frame, pa.binary())], names=["doc_id", "th", *cols, "bytes"])

    return stash(both.mapInArrow(run, f"doc_id {kind}, th long, anchor long, c long, crowd long, place long, bytes binary"), "bytes")


def _compare(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans of the frames that occur once, from the suffix arrays of whole anchors; rows: anchor, c, place, bytes."""

    def run(batches):
        kept: list[pa.Table] = []
        size = 0
        last = None

        def fold(t: pa.Table) -> pa.RecordBatch:
            texts = t.column("bytes").to_pylist()
            place = t.column("place").to_numpy()
            spans = _fold(texts, ((place >> 12) & 4095).tolist(), length)
            take, a, e = [], [], []
            for k, c in enumerate(t.column("c").to_pylist()):
                if c == 1:
                    at = int(place[k] >> 24)
                    for x, y in spans[k]:
                        take.append(k)
                        a.append(at + x)
                        e.append(at + y)
            own = t.select(["doc_id", "th"]).take(pa.array(take, pa.int64())).combine_chunks()
            doc, th = (own.column(c).combine_chunks() if own.num_rows else pa.array([], own.schema.field(c).type) for c in ("doc_id", "th"))
            return pa.RecordBatch.from_arrays([doc, th, pa.array(a, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "th", "a", "e"])

        # rows come sorted by anchor; whole anchors are taken together, about a megabyte at a time
        for b in batches:
            at = 0
            anchors = b.column("anchor").to_numpy()
            sizes = np.cumsum(pa.compute.binary_length(b.column("bytes")).to_numpy(zero_copy_only=False)) if b.num_rows else []
            new = np.flatnonzero(np.append([last is not None and b.num_rows and anchors[0] != last], anchors[1:] != anchors[:-1])) if b.num_rows else []
            for k in new:
                done = size + (int(sizes[k - 1]) if k else 0) - (int(sizes[at - 1]) if at else 0)
                if done >= 1 << 20:
                    if k > at:
                        kept.append(pa.Table.from_batches([b.slice(at, k - at)]))
                    if kept:
                        yield fold(pa.concat_tables(kept))
                    kept, size, at = [], 0, int(k)
            if b.num_rows > at:
                kept.append(pa.Table.from_batches([b.slice(at)]))
                size += int(sizes[-1]) - (int(sizes[at - 1]) if at else 0)
                last = anchors[-1]
        if kept:
            yield fold(pa.concat_tables(kept))

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.select("doc_id", "th", "anchor", "c", "place", "bytes").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, f"doc_id {kind}, th long, a long, e long")


def _split(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans for anchors with many different frames: by bands of windows and the bytes that a band shares, then by window."""
    schema = f"doc_id {kind}, th long, anchor long, frame long, place long, bytes binary"

    def bands(batches):
        for b in batches:
            take, anchor, frame, place, raw = [], [], [], [], []
            for k, (own, p, c, text) in enumerate(zip(*(b.column(x).to_pylist() for x in ("anchor", "place", "c", "bytes")), strict=True)):
                if c > 1:  # known to be covered, but others may match it
                    pass
                at, n, far = p >> 24, (p >> 12) & 4095, p & 4095
                for j in range(max(0, far - n + 1) // BAND, far // BAND + 1):
                    lo, hi = max(0, far - BAND * j - BAND + 1), min(n - 1, far - BAND * j)
                    if lo > hi:
                        continue
                    core = text[far - BAND * j : far - BAND * j + length - BAND + 1]
                    part = text[lo : hi + length]
                    take.append(k)
                    anchor.append(xxhash.xxh3_64_intdigest(core, (own ^ j) & (2**64 - 1)) - 2**63)
                    frame.append(xxhash.xxh3_64_intdigest(part) - 2**63)
                    place.append(((at + lo) << 24) | ((hi - lo + 1) << 12))
                    raw.append(part)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), pa.array(anchor, pa.int64()), pa.array(frame, pa.int64()), pa.array(place, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "th", "anchor", "frame", "place", "bytes"])

    rows = stash(rows.select("doc_id", "th", "anchor", "place", "c", "bytes").mapInArrow(bands, schema), "bands")
    at, n = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(4095)
    count = rows.groupBy("anchor", "frame").agg(F.count(F.lit(1)).alias("c"))
    crowd = count.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd"))
    count = stash(count.join(crowd, "anchor").filter("c > 1 or crowd > 1"), "band_counts")
    whole = rows.drop("bytes").join(count.filter("c > 1").select("anchor", "frame"), ["anchor", "frame"]).select("doc_id", "th", at.alias("a"), (at + n + (length - 1)).alias("e"))
    mixed = rows.join(count.filter("crowd > 1"), ["anchor", "frame"])
    few = mixed.filter(F.col("crowd") <= TOGETHER).groupBy("anchor", "frame").agg(F.min(F.struct("doc_id", "th", "place", "c", "bytes")).alias("r")).select("anchor", "r.*")
    # still many: the bytes that the band's windows share are the same, only what lies around differs; windows one by one
    i = F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    one = mixed.filter(F.col("crowd") > TOGETHER).select("doc_id", "th", at.alias("at"), "anchor", "bytes", i.alias("i"))
    window = F.substring("bytes", F.col("i") + 1, F.lit(length))
    one = one.select("doc_id", "th", (F.col("at") + F.col("i")).alias("a"), "anchor", F.xxhash64(window).alias("w1"), F.xxhash64(window, F.lit(1)).alias("w2"))
    again = one.groupBy("anchor", "w1", "w2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    single = one.join(again, ["anchor", "w1", "w2"]).select("doc_id", "th", "a", (F.col("a") + length).alias("e"))
    return whole.unionByName(_compare(few, kind, length)).unionByName(single)


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of each row: the texts without their repeated bytes."""
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs.select("doc_id", "text"), length=length)
    per_doc = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "e"))).alias("spans")).withColumnRenamed("doc_id", "d").withColumnRenamed("th", "h")
    both = packed(docs, kind).join(per_doc, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")), "left").select("doc_id", "z", "spans")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            size, gone, number, kept = [], [], [], []
            for z, spans in zip(b.column("z"), b.column("spans").to_pylist(), strict=True):
                raw = unpack.decompress(z.as_buffer())
                merged: list[list[int]] = []
                for x in spans or ():
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["a"], x["e"]])
                parts, end = [], 0
                for a, e in merged:
                    parts.append(raw[end:a])
                    end = e
                parts.append(raw[end:])
                size.append(len(raw))
                gone.append(sum(e - a for a, e in merged))
                number.append(len(merged))
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()), pa.array(kept, pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what stays of every document without its repeated 200-byte strings, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
