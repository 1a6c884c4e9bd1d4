"""HyperMinHash near-duplicate documents (operator 2).

A document's shingle hashes are dealt to ``REGISTERS`` buckets by their top
bits; a bucket keeps of its least hash the count of leading zeros and ten
mantissa bits, in 16 bits. Empty buckets borrow from a bucket that both of two
equal sets would choose. Bands of registers are bucket keys; a candidate pair
must pass the Jaccard estimate, corrected for register collisions, and is then
confirmed on the full shingle sets, made again from the whole texts.

Equal sets are one class from the start, so copies are never paired. A pair at
the least similarity is missed by all bands with a probability of
(1 - 0.8**4)**32, about 5e-8.

Defined cases: a text without words, or null, has an empty set and is linked
with nothing; a text with fewer words than a shingle is one shingle; rows that
repeat a doc_id get that id's smallest component; a null doc_id is linked
with nothing, its component is null and it is not kept; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._pairs import Search, link, screen, star
from ._store import packed, stash, unpacked

REGISTERS, BANDS = 128, 32
MANTISSA = 10
#: Standard deviations by which an estimate may fall short.
SLACK = 6.0


def sets_of(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the documents of a chunk, and their offsets."""
    low = X.LOWER[data]
    s, e, doc = X.words(low, offs)
    h = X.span_hash(low, s, e)
    n = len(offs) - 1
    return X.distinct_by_doc(*X.shingles(h, doc, n, size), n)


def registers(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The registers (documents x REGISTERS, uint16) of sorted distinct hashes."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    slot = doc * REGISTERS + (h >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = slot[1:] != slot[:-1]  # sorted: the first of a bucket is its least
    v = h[first] << np.uint64(7)
    length = np.frexp((v >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.minimum(53 - length, 50).astype(np.uint64)
    mantissa = (v << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(n * REGISTERS, np.uint16)
    full = np.zeros(n * REGISTERS, bool)
    out[slot[first]] = (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    full[slot[first]] = True
    empty = np.flatnonzero(~full & np.repeat(np.diff(offs) > 0, REGISTERS))
    home = full.copy()
    for k in range(1, 4096):
        if not len(empty):
            break
        b = (empty % REGISTERS).astype(np.uint64)
        donor = empty - empty % REGISTERS + (X.mix(b * np.uint64(4099) + np.uint64(k)) >> np.uint64(57)).astype(np.int64)
        ok = home[donor]
        out[empty[ok]] = out[donor[ok]]
        empty = empty[~ok]
    return out.reshape(n, REGISTERS)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that a register of unrelated sets of n and m hashes agrees by collision."""
    edge = 0.5 ** np.arange(52)
    part = lambda x: np.diff(-((1 - edge)[None, :] ** (np.maximum(x, REGISTERS)[:, None] / REGISTERS)), axis=1)
    return np.abs((part(n) * part(m)).sum(axis=1)) / (1 << MANTISSA)


def passes(least: float):
    """compare() for _pairs: sizes and corrected estimates of notes (8 bytes size, registers)."""

    def compare(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a = np.frombuffer(b"".join(left), np.uint8).reshape(len(left), -1)
        b = np.frombuffer(b"".join(right), np.uint8).reshape(len(right), -1)
        n, m = (np.ascontiguousarray(x[:, :8]).view("<i8").ravel() for x in (a, b))
        ra, rb = (np.ascontiguousarray(x[:, 8:]).view("<u2") for x in (a, b))
        small, large = np.minimum(n, m), np.maximum(n, m)
        share = (ra == rb).mean(axis=1)
        c = chance(n, m)
        estimate = (share - c) / (1 - c)
        # registers that were borrowed tell nothing new
        slack = SLACK * np.sqrt(least * (1 - least) / np.minimum(np.maximum(small, 1), REGISTERS))
        return (small >= least * large) & (estimate >= least - slack)

    return compare


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row; key is a long.

    Linked: 100 * |A and B| >= percent * |A or B| on sets of ``size``-word shingles.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    least = percent / 100

    def sketch(batches):
        for t in batches:
            for i, j, data, offs in X.chunks(t.column("text")):
                h, at = sets_of(data, offs, size)
                n = np.diff(at)
                raw = memoryview(h.tobytes())
                marks = [xxhash.xxh3_128_digest(raw[at[k] * 8 : at[k + 1] * 8]) for k in range(j - i)]
                reg = registers(h, at)
                note = np.concatenate((n.astype("<i8").view(np.uint8).reshape(-1, 8), reg.view(np.uint8).reshape(j - i, -1)), axis=1).tobytes()
                width = 8 + 2 * REGISTERS
                notes = [note[k * width : (k + 1) * width] for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([t.column("id").slice(i, j - i), pa.array(n), pa.array(marks, pa.binary()), pa.array(notes, pa.binary())], names=["id", "n", "mark", "note"])
            X.trim()

    found = stash(docs.mapInArrow(sketch, "id long, n long, mark binary, note binary"), "sketches")
    valid = found.filter("n > 0 and id is not null")
    # equal sets are one class, known by its smallest id
    ids = valid.groupBy("mark").agg(F.min("id").alias("class"))
    member = stash(valid.select("id", "mark").distinct().join(ids, "mark").select("id", "class"), "members")
    one = valid.groupBy("mark").agg(F.min(F.struct("id", "note")).alias("r"))
    # an id with several texts leads several classes; its note is any, its texts are all tried below
    notes = one.select("r.id", "r.note")
    rows = 2 * REGISTERS // BANDS
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(note, 9 + b * {rows}, {rows})))")
    keys = notes.select(F.explode(F.array_distinct(band)).alias("key"), "id").distinct()

    def fetch(ids: DataFrame) -> DataFrame:
        return packed(docs.filter("id is not null"), "text", "note").join(ids, "id")

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("note").alias("ta"))
        b = texts.select(F.col("id").alias("b"), F.col("note").alias("tb"))

        def run(batches):
            for t in batches:
                for s in range(0, t.num_rows, 512):  # packed texts grow when they are opened
                    own = t.slice(s, 512)
                    left, right = (_sets(own.column(c), size) for c in ("ta", "tb"))
                    ok = np.zeros(own.num_rows, bool)
                    for k, (x, y) in enumerate(zip(left, right, strict=True)):
                        both = _common(x, y)
                        ok[k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                    yield pa.RecordBatch.from_arrays([own.column("a"), own.column("b")], names=["a", "b"]).filter(pa.array(ok))

        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")

    buckets = stash(star(keys), "buckets")
    pairs = buckets.filter("id <> via").select(F.col("via").alias("a"), F.col("id").alias("b")).distinct()
    pairs = stash(screen(pairs, notes, passes(least)), "pairs")
    comps = link(pairs, buckets.filter("n >= 3").drop("via"), fetch, verify, _Sets(size, percent))
    # members that carry several classes (repeated ids) tie them together
    several = member.groupBy("id").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y")
    if not several.isEmpty():
        ties = member.join(several.select("id", "x"), "id").select(F.col("x").alias("a"), F.col("class").alias("b"))
        comps = components_again(comps, ties)
    final = member.groupBy("id").agg(F.min("class").alias("class")).join(comps.select(F.col("id").alias("class"), "comp"), "class", "left").select("id", F.coalesce("comp", "class").alias("component_id"))
    out = found.select("id", "n").join(final, "id", "left")
    # without shingles a document is its own component
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))


def components_again(comps: DataFrame, ties: DataFrame) -> DataFrame:
    from ._graph import components

    return components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(ties))


class _Sets(Search):
    """Links by full sets: a query's shingles are marked and counted in all other sets of the block at once."""

    def __init__(self, size: int, percent: int):
        self.size, self.percent = size, percent

    def prepare(self, notes: pa.ChunkedArray):
        own = [x for c in notes.chunks for x in _sets(c, self.size)]
        n = np.array([len(x) for x in own])
        number = np.unique(np.concatenate(own), return_inverse=True)[1]
        return n, np.concatenate(([0], np.cumsum(n))), number, np.zeros(int(number.max(initial=0)) + 1, np.int64)

    def find(self, ready, i: int, j: np.ndarray) -> np.ndarray:
        n, at, number, marks = ready
        own = number[at[i] : at[i + 1]]
        lo = at[j[0]]
        marks[own] = 1
        sums = np.concatenate(([0], np.cumsum(marks[number[lo : at[j[-1] + 1]]])))
        marks[own] = 0
        both = sums[at[j + 1] - lo] - sums[at[j] - lo]
        return (both > 0) & (100 * both >= self.percent * (n[i] + n[j] - both))


def _sets(notes: pa.Array, size: int) -> list[np.ndarray]:
    """The shingle sets of packed texts; equal texts are opened once."""
    values = notes.dictionary_encode()
    own: list[np.ndarray] = []
    for _, _, data, offs in X.chunks(unpacked(values.dictionary)):
        h, at = sets_of(data, offs, size)
        own += [h[at[k] : at[k + 1]] for k in range(len(offs) - 1)]
    none = np.zeros(0, np.uint64)
    return [none if i is None else own[i] for i in values.indices.to_pylist()]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if not len(x) or not len(y):
        return 0
    z = np.concatenate((x, y))
    z.sort(kind="stable")
    return int((z[1:] == z[:-1]).sum())


def query(spark, sf_dir: str) -> DataFrame:
    """op2: components of near-duplicate documents on two-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, size=2)
