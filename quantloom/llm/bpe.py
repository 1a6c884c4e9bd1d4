"""Byte-level BPE encoding and decoding by a global distinct-word shuffle (operator 8).

1. Documents are cut into pre-tokens by numpy over code point classes, which
   gives what the tokeniser's pattern matches. A block of documents keeps its
   distinct words and, as positions, each document's word numbers in order.
2. The blocks' words are dealt by hash to as many buckets as there are shuffle
   partitions (or blocks, if these are fewer), so rows grow in proportion to the
   blocks. Each distinct word is encoded once; its ids go back to every block
   that has it. Words are told apart by their bytes, never by a hash alone.
3. A block meets its words' ids again and its documents are reassembled by
   position. Decoding looks ids up in the token-byte table, of fixed size.

Words travel packed, one row for each block and bucket, so the shuffles move
a few bytes for each distinct word of a block and none for its repeats.

Defined cases: null and empty texts have no tokens, and the hashes of empty
strings; a text of any length is one document of one block; ties and repeated
rows are encoded alike; a null key stays null; an empty table gives an empty
result; columns other than key and text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _text as X
from ._store import stash

#: Bytes of text in a block; one longer text is a block of its own.
BLOCK_BYTES = 28 << 20
LETTER, NUMBER, BLANK, OTHER = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: the pattern's letters, numbers, white space, or other."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        hit = np.frombuffer("".join(regex.findall(f"{pattern}+", every)).encode("utf-32-le"), np.uint32)
        out[hit] = kind
    return out


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and document numbers of the pre-tokens of a chunk, in order."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(cp) != len(lead):
        raise ValueError("texts must be valid UTF-8")
    kind = classes()[cp]
    m = len(cp)
    doc_first = np.zeros(m + 1, bool)
    doc_first[np.searchsorted(lead, offs)] = True
    new_doc = doc_first[:m]
    run = np.ones(m, bool)  # a run of one class begins
    run[1:] = (kind[1:] != kind[:-1]) | new_doc[1:]
    begin = run.copy()
    blank = kind == BLANK
    # of white space before a text, the last character stands apart: a space joins what follows, others stay alone
    last = np.zeros(m, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~new_doc[1:]
    begin |= last
    joins = last & (cp == 0x20)
    begin[1:] &= ~joins[:-1]
    # contractions: a lone apostrophe that no space joins, and then letters that match
    quote = np.flatnonzero((cp == 0x27) & begin)
    quote = quote[quote + 1 < m]
    if len(quote):
        after = np.concatenate((cp, np.zeros(3, np.uint32)))
        one, two = after[quote + 1], after[quote + 2]
        in_doc = ~new_doc[quote + 1]
        in_doc2 = in_doc & ~doc_first[np.minimum(quote + 2, m)] & (quote + 2 < m)
        single = in_doc & np.isin(one, [ord(c) for c in "stmd"])
        double = in_doc2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, width in ((single, 2), (double, 3)):
            at = quote[hit]
            begin[at + 1] = False
            if width == 3:
                begin[at + 2] = False
            at = at[at + width < m]
            begin[at + width] = True
    first = np.flatnonzero(begin)
    starts = lead[first]
    return starts, np.append(starts[1:], n), np.searchsorted(offs, starts, "right") - 1


def slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after another."""
    total = int(lengths.sum())
    step = np.ones(total, np.int64)
    if not total:
        return data[:0]
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    head = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    step[head] = np.concatenate(([starts[0]], starts[1:] - (starts[:-1] + lengths[:-1] - 1)))
    return data[np.cumsum(step)]


def _pack(*arrays: np.ndarray, level: int = 9) -> bytes:
    raw = b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Byte planes of the differences of ascending numbers."""
    return _planes(np.diff(ascending, prepend=0))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, np.uint8, n, at + 8).view(kind) if n else np.zeros(0, kind))
        at += 8 + n
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """Byte planes of 24-bit-and-more numbers: each compresses by itself."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _block(text: pa.Array) -> tuple[bytes, bytes]:
    """Packed positions (words of each document, word numbers) and vocabulary (lengths, bytes) of a block."""
    # numbers of words within a chunk come first, so that no array of hashes is as long as the block
    codes, counts, reps = [], [], []
    for i, j, data, offs in X.chunks(text):
        s, e, doc = pretokens(data, offs)
        counts.append(np.bincount(doc, minlength=j - i))
        first, own = X.distinct_spans(data, s, e)
        codes.append(own.astype(np.uint32))
        lengths = e[first] - s[first]
        reps.append((lengths, slices(data, s[first], lengths), np.bincount(own, minlength=len(first))))
    all_len, all_bytes, times = (np.concatenate([r[k] for r in reps]) if reps else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.uint8, np.int64)))
    ends = np.cumsum(all_len)
    pick, code = X.distinct_spans(all_bytes, ends - all_len, ends)
    rank = np.empty(len(pick), np.int64)
    order = np.argsort(-np.bincount(code, times, len(pick)), kind="stable")
    rank[order] = np.arange(len(pick))
    pick = pick[order]
    at = np.cumsum([0, *(len(r[0]) for r in reps)])
    numbers = rank[code].astype(np.uint32)
    place = np.concatenate([numbers[at[k] : at[k + 1]][c] for k, c in enumerate(codes)]) if codes else np.zeros(0, np.uint32)
    words = slices(all_bytes, ends[pick] - all_len[pick], all_len[pick])
    lens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return _pack(lens.astype(np.int64), _planes(place)), _pack(all_len[pick].astype("<u4"), words)


def _split(lengths: np.ndarray, raw: np.ndarray) -> list[bytes]:
    data, out, at = raw.tobytes(), [], 0
    for n in lengths.tolist():
        out.append(data[at : at + n])
        at += n
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode(df: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row; with_ids adds ids array<int>.

    ranks_path: the rank file, read by the driver; its size is fixed.
    """
    spark = df.sparkSession
    key_type = df.schema[key].dataType
    loaded = load_ranks(ranks_path)
    mark = hashlib.sha256(repr(sorted(loaded.items())).encode()).hexdigest()
    ranks = spark.sparkContext.broadcast(loaded)
    blocks_type = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("places", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, kept, size
            table = pa.Table.from_batches(kept).combine_chunks()
            keys, texts = (table.column(i).combine_chunks() for i in (0, 1))
            if isinstance(texts, pa.ChunkedArray):
                texts = pa.concat_arrays(texts.chunks)
            places, words = _block(texts)
            number, kept, size = number + 1, [], 0
            X.trim()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([places], pa.binary()), pa.array([words], pa.binary())], names=["block", "keys", "places", "words"])

        for b in batches:
            for i, j, data, _ in X.chunks(b.column(1), block_bytes // 8):
                kept.append(b.slice(i, j - i))
                size += len(data)
                if size >= block_bytes or sum(x.num_rows for x in kept) >= 1 << 20:
                    yield flush()
        if kept:
            yield flush()

    blocks = stash(df.select(key, text).mapInArrow(cut, blocks_type), "blocks")
    n_buckets = max(1, min(blocks.select("block").count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lengths, raw = _unpack(blob, "<u4", np.uint8)
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                bucket = (X.span_hash(raw, starts, ends) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                for k in range(n_buckets):
                    at = order[cuts[k] : cuts[k + 1]]
                    if len(at):
                        part = _pack(_steps(at), _planes(lengths[at]), slices(raw, starts[at], lengths[at].astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([block]), pa.array([part], pa.binary())], names=["bucket", "block", "part"])

    def encode_bucket(table: pa.Table) -> pa.Table:
        import public_tokenizers
        import tiktoken

        enc = _encoder(tiktoken, public_tokenizers.PATTERN, mark, ranks)
        known: dict[bytes, np.ndarray] = {}
        out = []
        for blob in table.column("part").to_pylist():
            at, lengths, raw = _unpack(blob, np.uint8, np.uint8, np.uint8)
            ids = []
            for w in _split(_numbers(lengths), raw):
                got = known.get(w)
                if got is None:
                    got = known[w] = np.array(enc.encode_ordinary(w.decode()), "<u4")
                ids.append(got)
            n = np.fromiter(map(len, ids), np.uint32, len(ids))
            out.append(_pack(at, _planes(n), _planes(np.concatenate(ids))))
        return pa.table({"block": table.column("block"), "ids": pa.array(out, pa.binary())})

    coded = blocks.select("block", "words").mapInArrow(deal, "bucket long, block long, part binary").groupBy("bucket").applyInArrow(encode_bucket, "block long, ids binary")
    fields = [T.StructField(key, key_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def join_block(block: pa.Table, found: pa.Table) -> pa.Table:
        table = _byte_table(mark, ranks)
        parts = [[_numbers(p) for p in _unpack(x, np.uint8, np.uint8, np.uint8)] for x in found.column("ids").to_pylist()]
        size = sum(len(p[0]) for p in parts)
        counts, begins, spelled, decoded = np.zeros(size, np.int64), np.zeros(size, np.int64), [b""] * size, [b""] * size
        flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, "<u4")
        base = 0
        for steps, n, ids in parts:
            at = np.cumsum(steps.astype(np.int64))
            counts[at] = n
            begins[at] = base + np.cumsum(n.astype(np.int64)) - n
            base += len(ids)
            ids_list, end = ids.tolist(), 0
            for w, k in zip(at.tolist(), n.tolist(), strict=True):
                own = ids_list[end : end + k]
                end += k
                spelled[w] = ",".join(map(str, own)).encode()
                decoded[w] = b"".join([table[i] for i in own])
        rows: dict[str, list] = {f.name: [] for f in fields[1:]}
        for blob in block.column("places").to_pylist():
            lens, planes = _unpack(blob, np.int64, np.uint8)
            codes, end = _numbers(planes).astype(np.int64), 0
            for n in lens.tolist():
                own = codes[end : end + n]
                end += n
                listed = own.tolist()
                raw = b"".join([decoded[c] for c in listed])
                rows["n_tokens"].append(int(counts[own].sum()))
                rows["ids_sha256"].append(hashlib.sha256(b",".join([spelled[c] for c in listed])).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    rows["ids"].append(slices(flat, begins[own], counts[own]).astype(np.int32))
        codes = spelled = decoded = None
        X.trim()
        keys = block.column("keys").combine_chunks()
        keys = keys.flatten() if isinstance(keys, pa.ListArray) else pa.concat_arrays([c.flatten() for c in keys.chunks])
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.table({key: keys, **{c: pa.array(v, types.get(c, pa.string())) for c, v in rows.items()}})

    return blocks.select("block", "keys", "places").groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join_block, T.StructType(fields))


#: Of the last rank file that a worker met, known by its digest.
_cache: dict[tuple[str, str], object] = {}


def _cached(what: str, mark: str, make):
    if (what, mark) not in _cache:
        for k in [k for k in _cache if k[1] != mark]:
            del _cache[k]
        _cache[what, mark] = make()
    return _cache[what, mark]


def _encoder(tiktoken, pattern, mark: str, ranks):
    return _cached("encoder", mark, lambda: tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}))


def _byte_table(mark: str, ranks) -> list[bytes]:
    def make() -> list[bytes]:
        by_id = {i: b for b, i in ranks.value.items()}
        return [by_id.get(i, b"") for i in range(max(by_id) + 1)]

    return _cached("bytes", mark, make)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: digests of every document's ids and of the bytes decoded from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
