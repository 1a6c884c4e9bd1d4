"""Links between near copies from bucket keys, without all pairs of a bucket.

Members of a bucket are first compared with its leader only (the smallest id; a
large bucket is dealt in parts whose leaders are compared with the bucket's).
After verification the links are joined to components. Buckets that still hold
two components or more are searched in a second pass: members outside the
largest of them are a query set that meets all members of other components
in blocks. So every pair of a bucket is either in one component already or has
been compared, and no group is ever held or paired in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import stash
from ._text import trim

#: Members in a block of the second pass; a task holds two blocks.
BLOCK = 512
#: Members of a bucket that are compared with one of them.
FAN = 512

Compare = Callable[[list[bytes], list[bytes]], np.ndarray]


class Search:
    """How the second pass looks for links in a block: rows that find() gives and test() confirms are true links."""

    def prepare(self, notes: pa.ChunkedArray):
        raise NotImplementedError

    def find(self, ready, i: int, j: np.ndarray) -> np.ndarray:
        """A mask of j, ascending rows of i's block: which of them i may link to."""
        raise NotImplementedError

    def test(self, ready, i: int, k: int) -> bool:
        """Whether a row that find() gave is a true link."""
        return True


def star(keys: DataFrame, fan: int = FAN) -> DataFrame:
    """(key, id, lead, via, n) for the rows (key, id) of buckets of two or more ids; both sides of the joins stay numbers.

    lead: the least id of the bucket; via: the one that id is compared with. In
    a large bucket it is the least of its part, and that one is compared with lead.
    """
    led = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    rows = keys.join(led, "key")
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.col("n") / fan)).alias("part")
    large = rows.filter(F.col("n") > fan).select("*", part)
    via = large.groupBy("key", "part").agg(F.min("id").alias("first"))
    large = large.join(via, ["key", "part"]).withColumn("via", F.when(F.col("id") == F.col("first"), F.col("lead")).otherwise(F.col("first")))
    out = ["key", "id", "lead", "via", "n"]
    return rows.filter(F.col("n") <= fan).withColumn("via", F.col("lead")).select(*out).unionByName(large.select(*out))


def screen(pairs: DataFrame, notes: DataFrame, compare: Compare) -> DataFrame:
    """The pairs (a, b) whose notes pass ``compare``; notes: (id, note binary)."""
    left = notes.select(F.col("id").alias("a"), F.col("note").alias("na"))
    right = notes.select(F.col("id").alias("b"), F.col("note").alias("nb"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                ok = compare(t.column("na").to_pylist(), t.column("nb").to_pylist())
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb").mapInArrow(run, "a long, b long")


def rest(buckets: DataFrame, comps: DataFrame, texts: DataFrame, search: Search, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join different components, of pairs that share a bucket and were not compared yet.

    buckets: star()'s rows of buckets of three or more; comps: (id, comp);
    texts: (id, note) for search. Buckets with equal members are searched once.
    """
    b = buckets.select("key", "id").join(comps.select("id", "comp"), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    # buckets with members outside their largest component, one of those with the same members
    mixed = (
        b.groupBy("key", "comp")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        .filter("n > most.n")
        .groupBy("x", "y", "n")
        .agg(F.min(F.struct("key", "most")).alias("one"))
        .select("one.key", F.col("one.most.comp").alias("largest"), F.ceil(F.col("n") / block).cast("int").alias("n_all"), F.ceil((F.col("n") - F.col("one.most.n")) / block).cast("int").alias("n_query"))
    )
    b = b.join(mixed, "key").withColumn("out", F.col("comp") != F.col("largest")).join(texts, "id")
    part = lambda c: F.pmod(F.xxhash64("id", F.lit(3)), F.col(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda q, a, asks: F.struct(q.alias("qi"), a.alias("ai"), F.lit(asks).alias("query"))
    answers = F.transform(upto("n_query"), lambda q: place(q, part("n_all"), False))
    asks = F.when(F.col("out"), F.transform(upto("n_all"), lambda a: place(part("n_query"), a, True))).otherwise(F.array().cast("array<struct<qi:int,ai:int,query:boolean>>"))
    rows = b.select("key", "id", "comp", "note", F.explode(F.concat(answers, asks)).alias("at")).select("key", "at.*", "id", "comp", "note")

    order = ["key", "qi", "ai"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for t in whole_groups(batches, order, "note"):
            ids, comp = (t.column(c).to_numpy() for c in ("id", "comp"))
            asks = np.asarray(t.column("query").to_pylist(), bool)
            ready = search.prepare(t.column("note"))
            found: list[tuple[int, int]] = []
            for x, y in zip(*group_edges(t, order), strict=True):
                found += _meet(ids, comp, asks, x, y, search, ready)
            a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            trim()

    return rows.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def _meet(ids, comp, asks, x: int, y: int, search: Search, ready) -> list[tuple[int, int]]:
    """Links of the rows x..y, one block: query rows meet rows of other components until these are joined."""
    w = x + np.flatnonzero(~asks[x:y])
    label: dict[int, int] = {}

    def top(c: int) -> int:
        while c in label:
            c = label[c]
        return c

    out = []
    for i in x + np.flatnonzero(asks[x:y]):
        j = w[comp[w] != comp[i]]
        if not len(j):
            continue
        for k in j[search.find(ready, i, j)].tolist():
            p, q = top(int(comp[i])), top(int(comp[k]))
            if p != q and search.test(ready, i, k):
                label[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[k])))
    return out


def group_edges(t: pa.Table, keys: list[str]) -> tuple[list[int], list[int]]:
    """Firsts and ends of the runs of equal keys."""
    if not t.num_rows:
        return [], []
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for c in keys:
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    first = np.flatnonzero(new)
    return first.tolist(), np.append(first[1:], t.num_rows).tolist()


def whole_groups(batches, keys: list[str], wide: str, most: int = 4 << 20):
    """Tables of whole groups of sorted rows, of about ``most`` bytes in column ``wide``, or one larger group."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        if sum(t.column(wide).nbytes for t in held) < most:
            continue
        t = pa.concat_tables(held)
        first, _ = group_edges(t, keys)
        size = np.concatenate(([0], np.cumsum(pa.compute.binary_length(t.column(wide)).to_numpy())))
        at = 0
        for k in first[1:]:
            if size[k] - size[at] >= most:
                yield t.slice(at, k - at)
                at = k
        # the last group may go on; what lies before it goes if it is large enough by itself
        held = [t.slice(at)]
    if held:
        yield pa.concat_tables(held)


def link(pairs: DataFrame, larger: DataFrame, fetch: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], search: Search) -> DataFrame:
    """(id, comp) for the ids that have links.

    pairs: written rows (a, b) of the first pass; larger: rows (key, id, lead, n)
    of the buckets that these pairs do not exhaust; fetch(ids) gives (id, note),
    what ids are verified by, and is called once, for the ids of both;
    verify(pairs (a, b), texts) gives the true links.
    """
    texts = stash(fetch(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(larger.select("id")).distinct()), "texts")
    comps = components(stash(verify(pairs, texts), "linked"))
    more = stash(rest(larger, comps, texts, search), "more")
    if more.isEmpty():
        return comps
    # first components shrink to their labels, and only labels that get new links are joined again
    ends = more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left")
    ends = stash(ends.select("id", F.coalesce("comp", "id").alias("comp"), F.col("comp").isNull().alias("new")), "ends")
    side = lambda x: ends.select(F.col("id").alias(x), F.col("comp").alias(f"{x}_comp"))
    merged = components(more.join(side("a"), "a").join(side("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    every = comps.select("id", "comp").unionByName(ends.filter("new").select("id", "comp"))
    return every.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
