"""Quality rules from compression bands (operator 10).

zstandard ratios (compressed / raw bytes) of the whole text and of fixed
chunks are held against limits that depend on the length: text that repeats
itself compresses too well, noise hardly at all.

Defined cases: a null text is an empty text; texts with fewer than
``min_words`` words fail the base rule; texts under the smallest band are not
judged by ratio, texts under a chunk by the whole ratio only; the last chunk
overlaps the one before it so that no byte is left out. Rows are judged one by one, so ties and repeated rows get
equal verdicts, and every other column is passed through untouched unless its
name is one of the result's, which then is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X

#: (smallest byte length, lowest ratio, highest ratio) of whole texts; a text takes the last band that fits its length.
BANDS = ((200, 0.35, 0.98), (600, 0.33, 0.85), (2_000, 0.30, 0.74), (8_000, 0.28, 0.72))
#: Fixed chunks: bytes, lowest and highest ratio, and the share of chunks outside them that a text may have.
CHUNK = (2_048, 0.30, 0.74, 0.34)
SYMBOLS = b"#*$%&|<>"

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("zstd_ratio", T.DoubleType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_bad_chunks", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("band_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True


def _by_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each document of a chunk."""
    n = len(offs) - 1
    starts, ends, doc = X.words(data, offs)
    h = X.span_hash(data, starts, ends)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    at = np.flatnonzero(_SYM[data])
    out = {
        "n_words": _by_doc(doc, n),
        "word_chars": _by_doc(doc, n, (points[ends] - points[starts]).astype(float)),
        "n_symbols": _by_doc(np.searchsorted(offs, at, "right") - 1, n),
    }
    # lines with a word; equal hashes of a document are confirmed on the lines' bytes
    l_start, l_end, l_doc = X.edges(data != 0x0A, offs)
    has = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end, l_doc = l_start[has], l_end[has], l_doc[has]
    at = np.flatnonzero(_shared(X.span_hash(data, l_start, l_end), l_doc))
    own = X.distinct_spans(data, l_start[at], l_end[at])[1]
    again = np.ones(len(at), bool)
    again[np.unique(l_doc[at] * np.int64(len(at) + 1) + own, return_index=True)[1]] = False
    out["n_dup_lines"] = _by_doc(l_doc[at[again]], n)
    # words under a five-word window that occurs twice or more in its document
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(h) >= 5:
        roll = np.zeros(len(h) - 4, np.uint64)
        for k in range(5):
            roll = X.mix(roll * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - 4 + k])
        at = np.flatnonzero(doc[:-4] == doc[4:])
        at = at[_shared(roll[at], doc[at])]
        # windows of equal hashes are numbered by their words, and these by their bytes
        used, back = np.unique((at[:, None] + np.arange(5)).ravel(), return_inverse=True)
        word = X.distinct_spans(data, starts[used], ends[used])[1][back].reshape(-1, 5).astype(np.int64)
        number = doc[at]
        for k in range(5):
            number = np.unique(number * np.int64(len(used) + 1) + word[:, k], return_inverse=True)[1].astype(np.int64)
        at = at[np.bincount(number, minlength=1)[number] > 1]
        change = np.zeros(len(h) + 1, np.int64)
        change[at] += 1
        np.subtract.at(change, at + 5, 1)
        out["n_repeat_words"] = _by_doc(doc[np.cumsum(change)[:-1] > 0], n)
    return out


def _shared(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which hashes their document has more than once."""
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def band(n_bytes: int, bands=BANDS) -> tuple[float, float] | None:
    """The ratio limits for a length, None under the first band."""
    found = None
    for least, low, high in bands:
        if n_bytes >= least:
            found = (low, high)
    return found


def ratios(data: bytes | memoryview, pack: zstandard.ZstdCompressor, chunk: int) -> tuple[float, list[float]]:
    """The whole text's ratio (1.0 if empty), and those of its chunks; the last chunk ends where the text ends."""
    n = len(data)
    if not n:
        return 1.0, []
    whole = len(pack.compress(data)) / n
    heads = [*range(0, n - chunk + 1, chunk)]
    if n > chunk and n % chunk:
        heads.append(n - chunk)
    return whole, [len(pack.compress(data[i : i + chunk])) / chunk for i in heads]


def judge(df: DataFrame, text: str = "text", bands=BANDS, chunk=CHUNK, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """``df`` with the counts, ratios and verdicts of ADDED for each row."""
    df = df.drop(*[f.name for f in ADDED if f.name in df.columns and f.name != text])
    schema = T.StructType([*df.schema.fields, *ADDED.fields])
    at = df.columns.index(text)
    names = df.columns
    size, low_c, high_c, share = chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        for b in batches:
            cols: dict[str, list[np.ndarray]] = {f.name: [] for f in ADDED}
            for i, j, data, offs in X.chunks(b.column(at)):
                got = base_counts(data, offs)
                raw = memoryview(np.ascontiguousarray(data))
                whole, n_chunks, n_bad, band_bad = (np.zeros(j - i, t) for t in (float, np.int64, np.int64, bool))
                for k in range(j - i):
                    r, parts = ratios(raw[offs[k] : offs[k + 1]], pack, size)
                    whole[k], n_chunks[k] = r, len(parts)
                    n_bad[k] = sum(not low_c <= x <= high_c for x in parts)
                    limits = band(int(offs[k + 1] - offs[k]), bands)
                    band_bad[k] = limits is not None and not limits[0] <= r <= limits[1]
                words = got["n_words"]
                got["base_failed"] = (words < min_words) | (100 * got["n_repeat_words"] > max_repeat_percent * words)
                got["band_failed"] = band_bad | (n_bad > share * n_chunks)
                got |= {"zstd_ratio": whole, "n_chunks": n_chunks, "n_bad_chunks": n_bad}
                got["kept"] = ~got["base_failed"] & ~got["band_failed"]
                for c in cols:
                    cols[c].append(got[c])
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.concatenate(v)) for v in cols.values())], names=[*names, *cols])
            X.trim()

    return df.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = [f.name for f in ADDED]
    return judge(docs).select("doc_id", *kept).withColumn("zstd_ratio", F.round("zstd_ratio", 6))
