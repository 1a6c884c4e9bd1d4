"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 9).

Terms are lower-cased runs of letters and their first 4 and 6 letters. All
terms of the labelled examples are used and all examples are indexed, clean ones
included. A term weighs its IDF, more if labelled toxic texts have it clearly
more often than others, and never nothing; counts are taken over distinct texts.
Texts are searched a batch at a time. The postings of their seldom terms are
summed in full; the ``DENSE`` most frequent terms stand as a matrix of bytes, in
blocks of ``BLOCK`` examples. Its codes and those of a text are rounded up, so a
product of whole numbers (by onnxruntime, or by numpy without it) and the sum
bound the cosine from above, and every example that may be among the k best is
compared in double precision, so the neighbours are exact. Votes are weighted by
cosine; together with the share of toxic examples, as a prior, they give the
score. evidence() returns the neighbours themselves, by the smallest id of the
example's text.

At most ``FIT_ROWS`` labelled rows, by the hash of their ids, are used, so the
index has a fixed bound.

Defined cases: null and empty texts, and texts without a known term, have no
neighbours and get the prior; without toxic labels every score is 0; neighbours
of equal cosine are taken in the examples' order; rows that repeat are scored
alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._labels import remainder, sample

FIT_ROWS = 24_000
NEIGHBOURS = 15
PREFIXES = (4, 6)
#: A term's weight is its IDF times FLOOR + (z / Z) ** 2, z > 0 being its distance from chance in toxic texts.
FLOOR, Z = 0.05, 8.0
#: Frequent terms held as a matrix of codes, examples in a block, texts in a batch, and the error that single precision may make.
DENSE, BLOCK, BATCH, ERROR = 4096, 1024, 256, 2e-5
#: Terms of more than WIDE times the usual weight stay out of the matrix; the code of an example's least weight, and what rounding may add to a code.
WIDE, ONCE, SLACK = 3.0, 23, 1e-4
#: Examples in a stripe at most; bounds of this part of the k-th largest are compared at once; the lower half of a number.
STRIPE, MARGIN, LOW = 64, 0.985, 0xFFFFFFFF
#: Top bits of a term's hash in the table that finds it.
SLOTS = 22
PRIOR_WEIGHT = 0.5


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case where that is one code point."""
    from .bpe import LETTER, classes

    small = np.arange(0x110000, dtype=np.uint32)
    is_letter = classes() == LETTER
    for c in np.flatnonzero(is_letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            small[c] = ord(low)
    return is_letter, small


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and document numbers of a chunk, with repeats."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    is_letter, small = _letters()
    at = np.searchsorted(lead, offs)
    s, e, doc = X.edges(is_letter[cp], at)
    low = small[cp].view(np.uint8)
    # two letters a step, each a bijection, so the words and their first letters are hashed together
    eight = X._eights(low)
    size = e - s
    state = np.full(len(s), 0x5851F42D4C957F2D, np.uint64)
    out, of = [state], [doc]
    at, k = np.arange(len(s)), 0
    while len(at := at[size[at] > k]) and k < X.LONG // 4:
        two = eight[4 * (s[at] + k)]
        two[size[at] == k + 1] &= np.uint64(0xFFFFFFFF)
        state[at] = X.mix(state[at] ^ two)
        k += 2
        if k in PREFIXES:
            longer = at[size[at] > k]
            out.append(X.mix(state[longer] + np.uint64(k)))
            of.append(doc[longer])
    out[0] = X.mix(state)
    if len(at):
        out[0][at] = X.span_hash(low, 4 * s[at], 4 * e[at])
    return np.concatenate(out), np.concatenate(of)


def _codes(x: np.ndarray, most: int) -> np.ndarray:
    """Positive numbers rounded up to 1..most, but for SLACK."""
    return np.clip(np.ceil(x - SLACK), 1, most).astype(np.uint8)


@lru_cache(1)
def _session():
    """A product of byte matrices with sums of 32 bits, or None without onnxruntime."""
    try:
        import onnxruntime
    except ImportError:
        return None
    # the model MatMulInteger(A, B) = Y as an ONNX protobuf: a field's number and kind, its length, its bytes
    field_ = lambda number, body: bytes([number << 3 | 2, len(body)]) + body
    whole = lambda number, x: bytes([number << 3, x])
    sides = lambda name, kind, dims: field_(1, name) + field_(2, field_(1, whole(1, kind) + field_(2, b"".join(field_(1, field_(2, d)) for d in dims))))
    node = field_(1, b"A") + field_(1, b"B") + field_(2, b"Y") + field_(4, b"MatMulInteger")
    graph = field_(1, node) + field_(2, b"g") + field_(11, sides(b"A", 2, (b"M", b"K"))) + field_(11, sides(b"B", 3, (b"K", b"N"))) + field_(12, sides(b"Y", 6, (b"M", b"N")))
    model = whole(1, 8) + field_(7, graph) + field_(8, field_(1, b"") + whole(2, 13))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.enable_cpu_mem_arena = False
    options.log_severity_level = 3
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of a matrix of bytes and one of signed bytes."""
    session = _session()
    if session is None or not a.shape[1]:
        return a.astype(np.float32) @ b.astype(np.float32)
    return session.run(None, {"A": a, "B": b})[0]


@dataclass
class Index:
    """Labelled examples by their terms, and terms by their examples."""

    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray  # by term, the weight of its distance from chance included
    prior: float
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by example
    ids: list = field(default_factory=list)  # by example
    weights: list[dict[int, float]] = field(default_factory=list)  # by example, unit length; build() flattens them
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of term and weight, by example
    term: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def build(self) -> Index:
        if self.weights:
            self.cuts = np.concatenate(([0], np.cumsum([len(r) for r in self.weights])))
            self.term = np.array([t for r in self.weights for t in r], np.int32)
            self.weight = np.array([w for r in self.weights for w in r.values()], np.float32)
            self.weights = []
        return self

    def __getstate__(self):
        """Small for the broadcast: steps between terms and bytes of equal rank together, compressed."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("_by_term", "_slots")}
        for k, v in (("term", np.diff(self.term, prepend=np.int32(0))), ("weight", self.weight)):
            planes = np.ascontiguousarray(v.astype(self.__dict__[k].dtype)).view(np.uint8).reshape(len(v), -1).T if len(v) else v
            state[k] = zstandard.ZstdCompressor(level=3).compress(planes.tobytes()), v.dtype.str, len(v)
        return state

    def __setstate__(self, state):
        for k in ("term", "weight"):
            raw, kind, n = state[k]
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8) if n else np.zeros(0, np.uint8)
            state[k] = np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind)
        state["term"] = np.cumsum(state["term"], dtype=state["term"].dtype)
        self.__dict__.update(state)

    def _inverted(self):
        """By term: cuts and postings, a double near the weight whose lower half is the example; a term's column among the frequent ones or -1; by example the value of a code, and the codes in blocks (columns x examples)."""
        if "_by_term" not in self.__dict__:
            n = np.bincount(self.term, minlength=len(self.vocabulary))
            often = np.argsort(-n, kind="stable")[:DENSE]
            often = often[(n[often] > 0) & (self.idf[often] > 0)]
            often = often[self.idf[often] <= WIDE * np.median(self.idf[often])] if len(often) else often
            column = np.full(len(n), -1, np.int32)
            column[often] = np.arange(len(often))
            n[often] = 0
            cuts = np.concatenate(([0], np.cumsum(n)))
            value = np.zeros(-(-len(self.toxic) // BLOCK) * BLOCK, np.float32)
            codes = np.zeros((len(value) // BLOCK, len(often), BLOCK), np.int8)
            postings, free = np.empty(cuts[-1], "<i8"), cuts[:-1].copy()
            for j in range(len(codes)):  # a block at a time, as workers share the executor's memory
                ends = self.cuts[j * BLOCK : (j + 1) * BLOCK + 1]
                own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                term, weight = self.term[ends[0] : ends[-1]], self.weight[ends[0] : ends[-1]]
                at = column[term]
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    # over its term's weight an example's weight tells only how often it has the term, so codes are small
                    tf = weight[hit] / self.idf[term[hit]]
                    first = np.flatnonzero(np.diff(own[hit], prepend=-1))
                    unit = np.zeros(len(ends) - 1, np.float32)
                    unit[own[hit[first]]] = np.maximum(np.minimum.reduceat(tf, first) / ONCE, np.maximum.reduceat(tf, first) / 127)
                    value[j * BLOCK : j * BLOCK + len(unit)] = unit
                    codes[j, at[hit], own[hit]] = _codes(tf / unit[own[hit]], 127)
                rest = np.flatnonzero(at < 0)
                rest = rest[np.argsort(term[rest], kind="stable")]
                u, first, several = np.unique(term[rest], return_index=True, return_counts=True)
                place = np.arange(len(rest)) + np.repeat(free[u] - first, several)
                postings[place] = (weight[rest].astype("<f8").view("<i8") & ~LOW) | (own[rest] + j * BLOCK)
                free[u] += several
            self._by_term = cuts, postings, column, value, codes
            del free
            X.trim()
        return self._by_term

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each unit vector (terms, weights) the k examples of largest cosine (over 0), and the cosines."""
        parts = max(1, round(len(vectors) / BATCH))
        cuts = [len(vectors) * i // parts for i in range(parts + 1)]
        return [x for a, e in zip(cuts, cuts[1:], strict=False) if a < e for x in self._batch(vectors[a:e], k)]

    def _batch(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts, postings, column, value, codes = self._inverted()
        rows, n = len(vectors), len(value)
        bound = np.zeros((rows, n), np.float32)  # no cosine is larger, but for ERROR
        row = np.repeat(np.arange(rows), [len(own) for own, _ in vectors])
        term, weight = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
        at = column[term]
        often = at >= 0
        row, at, w = row[often], at[often], weight[often] * self.idf[term[often]]
        step = np.zeros(rows)
        np.maximum.at(step, row, w / 255)
        asked = np.zeros((rows, codes.shape[1]), np.uint8)
        asked[row, at] = _codes(w / step[row], 255)
        step = (step * (1 + 4 * SLACK)).astype(np.float32)[:, None]
        for r, (own, u) in enumerate(vectors):
            seldom = column[own] < 0
            own = own[seldom]
            lo, hi = cuts[own], cuts[own + 1]
            if len(lo):
                found = np.concatenate([postings[x] for x in map(slice, lo.tolist(), hi.tolist())])
                parts = found.view("<f8") * np.repeat(u[seldom], hi - lo)
                found &= LOW
                bound[r] = np.bincount(found, parts, n)
        for j, block in enumerate(codes):
            some = slice(j * BLOCK, (j + 1) * BLOCK)
            part = _multiply(asked, block).astype(np.float32)
            part *= step
            part *= value[some]
            bound[:, some] += part
        # the largest of each stripe: the k-th of these is no larger than the k-th of all
        tops = np.maximum.reduceat(bound, np.arange(0, n, STRIPE), axis=1)
        few = tops.shape[1] - k
        tops = np.partition(tops, few, axis=1)[:, few] if few > 0 else np.zeros(rows)
        out = []
        whole, known = np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary), bool)
        least_bound = np.finfo(np.float32).tiny  # weights are positive, so a bound is 0 without a common term only
        for r, (own, u) in enumerate(vectors):
            whole[own], known[own] = u, True
            # some of the largest bounds give the least cosine that the others have to reach
            top = max(MARGIN * tops[r], least_bound)
            now = np.flatnonzero(bound[r] >= top)
            exact = self._cosines(known, whole, now)
            least = np.partition(exact, len(now) - k)[len(now) - k] - ERROR if len(now) >= k else 0
            if least < top and top > least_bound:
                more = np.flatnonzero((bound[r] >= max(least, least_bound)) & (bound[r] < top))
                now, exact = np.concatenate((now, more)), np.concatenate((exact, self._cosines(known, whole, more)))
            known[own] = False
            now, exact = now[exact > 0], exact[exact > 0]
            first = np.lexsort((now, -np.round(exact, 12)))[:k]
            out.append((now[first], exact[first]))
        return out

    def _cosines(self, known: np.ndarray, whole: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """The cosines of examples with a vector: whether it has a term, and the weights, of all terms."""
        lo, hi = self.cuts[examples], self.cuts[examples + 1]
        spans = list(map(slice, lo.tolist(), hi.tolist()))
        if not spans:
            return np.zeros(0)
        term = np.concatenate([self.term[x] for x in spans])
        common = np.flatnonzero(known.take(term))  # few are, and the table of these is small
        of = np.repeat(np.arange(len(examples)), hi - lo)[common]
        place = common + (hi - np.cumsum(hi - lo))[of]
        return np.bincount(of, whole.take(term[common]) * self.weight[place], len(examples))

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The scores of a chunk's documents."""
        found = self.vectors(data, offs)
        known = [r for r, v in enumerate(found) if len(v[0])]
        out = np.full(len(found), self.prior)
        for r, (i, c) in zip(known, self.nearest([found[r] for r in known]), strict=True):
            votes = c**2
            out[r] = (votes @ self.toxic[i] + PRIOR_WEIGHT * self.prior) / (votes.sum() + PRIOR_WEIGHT)
        return out

    def _place(self, h: np.ndarray) -> np.ndarray:
        """The numbers of terms in the vocabulary, -1 for others: most are found by their top bits, the rest by bisection."""
        if "_slots" not in self.__dict__:
            slots = np.full(1 << SLOTS, -1, np.int32)
            slots[(self.vocabulary >> np.uint64(64 - SLOTS)).astype(np.int64)] = np.arange(len(self.vocabulary), dtype=np.int32)
            self._slots = slots
        at = self._slots[(h >> np.uint64(64 - SLOTS)).astype(np.int64)].astype(np.int64)
        other = np.flatnonzero((at >= 0) & (self.vocabulary[at] != h))
        place = np.minimum(np.searchsorted(self.vocabulary, h[other]), len(self.vocabulary) - 1)
        at[other] = np.where(self.vocabulary[place] == h[other], place, -1)
        return at

    def vectors(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document its known terms' numbers and unit weights."""
        n = len(offs) - 1
        none = (np.zeros(0, np.int64), np.zeros(0))
        out = [none] * n
        if not len(self.vocabulary):
            return out
        h, doc = terms(data, offs)
        at = self._place(h)
        known = at >= 0
        pair, tf = np.unique(doc[known] * len(self.vocabulary) + at[known], return_counts=True)
        of, at = pair // len(self.vocabulary), pair % len(self.vocabulary)
        w = (1 + np.log(tf)) * self.idf[at]
        cuts = np.searchsorted(of, np.arange(n + 1))
        for k in np.unique(of).tolist():
            own = slice(cuts[k], cuts[k + 1])
            out[k] = (at[own], w[own] / np.sqrt((w[own] ** 2).sum()))
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, text: str = "text", key: str = "doc_id") -> Index:
    """The index of at most ``rows`` labelled documents."""
    known = sample(docs, labels, label, rows, text, key)
    one = known.groupBy(F.xxhash64(text).alias("mark")).agg(F.min(F.struct(text, "y")).alias("r"), F.min(key).alias("id")).select("mark", F.col(f"r.{text}").alias("text"), "r.y", "id")
    total, bad = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = bad / total if total else 0.0

    def count(batches):
        for b in batches:
            y = b.column("y").to_numpy()
            for i, _, data, offs in X.chunks(b.column("text")):
                h, doc = terms(data, offs)
                h, at = X.distinct_by_doc(h, doc, len(offs) - 1)
                u, back = np.unique(h, return_inverse=True)
                bad_of = np.repeat(y[i : i + len(offs) - 1], np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(back, minlength=len(u))), pa.array(np.bincount(back, bad_of, len(u)).astype(np.int64))], names=["term", "n", "bad"])

    counts = one.mapInArrow(count, "term long, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = counts.toArrow()
    h, n, hits = (found.column(c).to_numpy() for c in ("term", "n", "bad"))
    del found
    order = np.argsort(h.view(np.uint64))
    vocabulary, n, hits = h.view(np.uint64)[order], n[order].astype(float), hits[order]
    z = np.where(n > 1, (hits - n * base) / np.sqrt(np.maximum(n * base * (1 - base), 1e-9)), 0.0)
    index = Index(vocabulary, np.log((2 + total) / (1 + n)) * (FLOOR + (np.maximum(z, 0) / Z) ** 2), base)
    if not len(vocabulary):
        return index
    del h, n, hits, z, order
    X.trim()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def embed(batches):
        index = shared.value
        for b in batches:
            for i, j, data, offs in X.chunks(b.column("text")):
                got = index.vectors(data, offs)
                cuts = pa.array(np.concatenate(([0], np.cumsum([len(at) for at, _ in got]))), pa.int32())
                at = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([at for at, _ in got]).astype(np.int32)))
                w = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([w for _, w in got]).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("mark", "y", "id")), at, w], names=["mark", "y", "id", "at", "w"])

    kind = docs.schema[key].dataType.simpleString()
    got = one.mapInArrow(embed, f"mark long, y int, id {kind}, at array<int>, w array<float>").filter(F.size("at") > 0).toArrow()
    shared.destroy()
    # rows by mark, copied once, as the driver has little memory
    order = np.argsort(got.column("mark").to_numpy(), kind="stable")
    index.toxic = got.column("y").to_numpy()[order].astype(float)
    index.ids = got.column("id").take(pa.array(order)).to_pylist()
    size = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in got.column("at").chunks)]).astype(np.int64)
    index.cuts = np.concatenate(([0], np.cumsum(size[order])))
    place = np.empty(len(order), np.int64)
    place[order] = index.cuts[:-1]
    index.term, index.weight = np.empty(index.cuts[-1], np.int32), np.empty(index.cuts[-1], np.float32)
    for c, into in (("at", index.term), ("w", index.weight)):
        row = 0
        for chunk in got.column(c).chunks:
            flat, k = chunk.flatten().to_numpy(), 0
            for to, n in zip(place[row : row + len(chunk)].tolist(), size[row : row + len(chunk)].tolist(), strict=True):
                into[to : to + n] = flat[k : k + n]
                k += n
            row += len(chunk)
    flat = chunk = None
    del got
    X.trim()
    return index.build()


def score(docs: DataFrame, index: Index, least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with columns score and predicted; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    at, names = docs.columns.index(text), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(index)
    del index
    vars(shared).pop("_value", None)  # the driver reads it again if it is asked for
    X.trim()

    def run(batches):
        index = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            s = []
            for _, _, data, offs in X.chunks(b.column(at)):
                s.append(index.scores(data, offs))
            s = np.round(np.concatenate(s), 9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= least).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def evidence(docs: DataFrame, index: Index, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, example, cosine, toxic): the neighbours behind each score; example is an id of the labelled text."""
    kind = docs.schema[key].dataType
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([T.StructField(key, kind), T.StructField("example", kind), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.DoubleType())])

    def run(batches):
        index = shared.value
        for b in batches:
            for i, _, data, offs in X.chunks(b.column(1)):
                found = index.vectors(data, offs)
                known = [r for r, v in enumerate(found) if len(v[0])]
                near = index.nearest([found[r] for r in known])
                of = [i + r for r, (at, _) in zip(known, near, strict=True) for _ in at]
                ex = [e for at, _ in near for e in at.tolist()]
                cos = [c for _, own in near for c in own.tolist()]
                ids = pa.array([index.ids[e] for e in ex], b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), ids, pa.array(cos, pa.float64()), pa.array([float(index.toxic[e]) for e in ex], pa.float64())], names=[key, "example", "cosine", "toxic"])

    return docs.select(key, text).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: toxicity of every document; the index has not seen the fold with remainder 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs.withColumn("held_out", remainder("doc_id", 5) == 0), train(docs, labels.filter(remainder("doc_id", 5) != 0))).select("doc_id", "held_out", "score", "predicted")
