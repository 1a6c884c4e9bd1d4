"""Fuzzy line deduplication (operator 4).

Lines are normalised (A-Z lower-cased, digits to 0, ASCII punctuation dropped,
white space to single spaces). Equal lines of at least ``exact_words`` words are
one from the start. Different lines of at least ``min_words`` words are linked
if the edit distance of the normalised lines, counted in words, is at most
1 - ``least`` of the longer one.
Of each connected group the first occurrence by (doc_id, text hash, line
number) stays; all other occurrences are taken out of their documents.

Candidates are found without loss (prefix filter): a line of n words has n + 1
pairs of neighbouring words, its ends included. An edit takes away two
neighbouring pairs at most, an inserted word one, so lines within the limit keep
pairs in common, and the first of these, in any order that holds for all lines,
is among the first pairs of both that the allowed edits cannot take away
together. The order is by rarity in a sample, then by hash; it decides the cost
and never the result. Lines that share such a pair meet if their lengths and
the pair's place in both allow a link; then their texts are fetched and
compared, in blocks after a screen by counts of words in ``CELLS`` cells. With its keys a line carries
the parities of its words' counts in 128 cells: an edit changes one of them, or
two if it changes a word, so most pairs end where a key brings them together.

Defined cases: null and empty texts have no lines to lose and stay as they are;
lines shorter than both limits, and lines without a word, are never removed;
query() and the pipeline set ``exact_words`` to 1, so there equal lines of any
length go; rows that repeat a doc_id and its text are one
document and lose the same lines; a null doc_id is a document like others and
comes first; a document may lose all its lines and is then an empty text; an
empty table gives an empty result; other columns pass through, but columns
named n_lines or n_removed are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._pairs import Search, link
from ._store import packed, stash

MIN_WORDS = 5
#: Cells of word counts that screen two lines.
CELLS = 32
#: Sampled documents, kept words and pairs of words, and bits of the table that holds them, for the order by rarity.
SAMPLE, FREQUENT, SLOTS = 2048, 1 << 17, 22
#: Rounds of the search for pairs that do not touch; fewer rounds give more keys.
ROUNDS = 64
#: A bucket up to the first size gives the pairs of lines that may be linked, a larger one meets leader by leader and in
#: blocks; up to the second it is parted first into lines that no chain of such pairs joins.
SMALL, ALL_PAIRS = 1 << 14, 1 << 14
#: Buckets up to this size are paired many at a time; parts of larger ones with more pairs a line than MESHED, or buckets
#: with more than MOST pairs in all, meet leader by leader like the largest, so copies are not expanded.
TINY, MESHED, MOST = 64, 8, 1 << 20
#: Members of a bucket that are compared with one of them.
FAN = 512
#: Bytes of text that are cut into keys together, and keys that travel together.
CHUNK, FLUSH = 4 << 20, 1 << 20
#: The place of a pair that its line has more than once.
ANYWHERE = 0xFFFFFFFF
#: Columns of keys: pair, line, number of words, place, parities.
KINDS = ("<u8", "<i8", "<u4", "<u4", "<u8", "<u8")

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_NORM = X.LOWER.copy()
_NORM[48:58] = 48
_DROP = bytes(np.flatnonzero(_PUNCT).tolist())
_TABLE = bytes(_NORM.tolist())


def normal(line: bytes) -> bytes:
    """The normal form of one line."""
    return b" ".join(re.split(rb"[\x20\x09-\x0d]+", line.translate(_TABLE, _DROP).strip(b" \t\n\r\x0b\x0c")))


def _split(data: np.ndarray, offs: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Word hashes of a chunk; of each line with ``min_words`` words or more its first word, end, document, number and the hash of its normal form."""
    low = np.frombuffer(data.tobytes().translate(_TABLE, _DROP), np.uint8)
    at = offs - np.searchsorted(np.flatnonzero(_PUNCT[data]), offs)
    s, e, doc = X.words(low, at)
    # the number of line ends before each word, counted from its document's start
    ends = np.flatnonzero(low == 0x0A)
    line = np.cumsum(np.bincount(np.searchsorted(s, ends), minlength=len(s) + 1))[: len(s)] - np.searchsorted(ends, at)[doc] if len(s) else s
    h = X.span_hash(low, s, e)
    first = np.flatnonzero(np.append([True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]))[: len(s)])
    head, last = first, np.append(first[1:], len(s))[: len(first)]
    ok = last - first >= min_words
    first, last = first[ok], last[ok]
    # a line is known by its words and their places
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(head, np.diff(np.append(head, len(h)))).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(X.mix(h ^ X.mix(place + np.uint64(1))))))
    mark = X.mix(sums[last] - sums[first] + (last - first).astype(np.uint64))
    return h, first, last, doc[first], line[first], mark.view(np.int64)


def parities(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of word hashes the parities of their counts in 128 cells, a bit each, in two numbers."""
    bit = np.uint64(1) << (word >> np.uint64(58))
    side = (word & np.uint64(1 << 57)).astype(bool)
    return np.bitwise_xor.reduce(np.where(side, 0, bit), axis=1), np.bitwise_xor.reduce(np.where(side, bit, 0), axis=1)


def line_marks(data: np.ndarray, offs: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Of each line with ``min_words`` words or more: document, line number, hash of the normal form, number of its words and their counts by cell, 4 bits each in two numbers."""
    h, first, last, doc, line, mark = _split(data, offs, min_words)
    size = last - first
    cell = (h[_ranges(first, size)] >> np.uint64(40)).astype(np.int64) % CELLS
    n = np.bincount(np.repeat(np.arange(len(first)), size) * CELLS + cell, minlength=len(first) * CELLS)
    n = np.minimum(n, 15).astype(np.uint8).reshape(-1, 2)
    return doc, line, mark, size, (n[:, 0] << 4 | n[:, 1]).view(np.int64).reshape(-1, CELLS // 16)


def cell_counts(packed_cells: np.ndarray) -> np.ndarray:
    """The counts by cell of line_marks(), in any order that holds for all lines."""
    raw = np.ascontiguousarray(packed_cells).view(np.uint8).reshape(len(packed_cells), -1)
    return np.concatenate((raw >> 4, raw & 15), axis=1).astype(np.int32)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] numbers, then those of the next."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def most_edits(n, least: float):
    """The edits that a pair whose longer line has n words may have."""
    return np.round((1 - least) * np.asarray(n), 9).astype(np.int64)


@lru_cache(1 << 16)
def losses(n: int, least: float) -> tuple[list[int], list[int]]:
    """For a line of n words the numbers of edits that a linked line may need, and how many pairs each can take away."""
    more = np.arange(int(n / least) - n + 2)  # words that the other line has more, each of them inserted
    k = most_edits(n + more, least)
    k, at = np.unique(k[more <= k], return_index=True)
    return k.tolist(), (2 * k - at).tolist()


def pair_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of neighbouring words, line ends (1 and 2) included, the lines' numbers, and the two words."""
    size = last - first + 1
    of = np.repeat(np.arange(len(first)), size)
    at = _ranges(first, size)
    right = np.append(h, np.uint64(0))[at]
    right[at == last[of]] = 1
    left = np.append(h, np.uint64(0))[at - 1]
    left[at == first[of]] = 2
    return X.mix(X.mix(left) + right), of, left, right


def _apart(rank: np.ndarray) -> np.ndarray:
    """Places (lines x pairs) that do not touch within their line, taken in the order of their ranks."""
    far = np.iinfo(rank.dtype).max
    v, out = rank.copy(), np.zeros(rank.shape, bool)
    for _ in range(ROUNDS):
        won = v < far
        won[:, 1:] &= v[:, 1:] < v[:, :-1]
        won[:, :-1] &= v[:, :-1] < v[:, 1:]
        if not won.any():
            break
        out |= won
        v[won] = far
        v[:, 1:][won[:, :-1]] = far
        v[:, :-1][won[:, 1:]] = far
    return out


def line_keys(data: np.ndarray, offs: np.ndarray, least: float, table: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(pair, hash of the normal form, number of words, place, parities): the pairs by which linked lines meet; table: rarity()'s.

    Lines of one length are worked on together. A repeat of a line in the chunk gives no keys.
    """
    h, first, last, _, _, mark = _split(data, offs, min_words)
    new = np.sort(np.unique(mark, return_index=True)[1])
    first, last, mark = first[new], last[new], mark[new]
    size = last - first
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.append([True], size[order][1:] != size[order][:-1])) if len(order) else np.zeros(0, np.int64)
    shift = np.uint64(64 - SLOTS)
    out: list[tuple[np.ndarray, ...]] = []
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):
        n = int(size[order[lo]])
        for at in range(lo, hi, step := max(1, (1 << 18) // n)):
            own = order[at : min(at + step, hi)]
            word = np.empty((len(own), n + 2), np.uint64)
            word[:, 0], word[:, -1] = 2, 1  # the ends of a line
            word[:, 1:-1] = h[first[own][:, None] + np.arange(n)]
            pair = X.mix(X.mix(word[:, :-1]) + word[:, 1:])
            common = table[(word >> shift).astype(np.int64)].astype(np.uint64)
            common = (table[(pair >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(8)) | ((common[:, :-1] + common[:, 1:]) >> np.uint64(1))
            key = (common << np.uint64(48)) | (pair >> np.uint64(16))
            by = np.argsort(key, axis=1)
            rank = np.empty(by.shape, np.int32)
            np.put_along_axis(rank, by, np.broadcast_to(np.arange(n + 1, dtype=np.int32), by.shape), axis=1)
            picked = np.cumsum(np.take_along_axis(_apart(rank), by, axis=1), axis=1)
            # for each number of edits: pairs up to the one that these edits cannot reach, or more pairs than they can take
            edits, most = losses(n, least)
            cells = np.arange(len(own))[:, None] * (edits[-1] + 2) + np.minimum(picked, edits[-1] + 1)
            upto = np.cumsum(np.bincount(cells.ravel(), minlength=len(own) * (edits[-1] + 2)).reshape(len(own), -1), axis=1)
            wanted = np.minimum(upto[:, edits], most).max(axis=1) + 1
            key = np.take_along_axis(key, by, axis=1)
            again = np.zeros(key.shape, bool)
            again[:, 1:] = key[:, 1:] == key[:, :-1]
            several = again.copy()
            several[:, :-1] |= again[:, 1:]
            i, j = np.nonzero((np.arange(n + 1) < wanted[:, None]) & ~again)
            place = by[i, j]
            out.append((pair[i, place], mark[own[i]], np.full(len(i), n, np.uint32), np.where(several[i, j], ANYWHERE, place).astype(np.uint32), *(x[i] for x in parities(word[:, 1:-1]))))
    if not out:
        return tuple(np.zeros(0, kind) for kind in KINDS)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def rarity(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The table of commonness by the top bits of a hash; a shared slot only changes the order."""
    table = np.zeros(1 << SLOTS, np.uint8)
    np.maximum.at(table, (found >> np.uint64(64 - SLOTS)).astype(np.int64), np.minimum(np.log2(np.maximum(counts, 1)) * 8 + 1, 255).astype(np.uint8))
    return table


def _meets(n: tuple, place: tuple, odd: tuple, edits: np.ndarray) -> np.ndarray:
    """Whether lines may be linked by a key; each argument has both sides, edits are most_edits() by number of words.

    Its pair of words stays where it is while words come and go before and after
    it: the shifts of its distances from both line ends need as many edits.
    """
    (a, b), (p, q), (x, y) = n, place, odd
    k, more = edits[np.maximum(a, b)], np.abs(a - b)
    near = np.where((p == ANYWHERE) | (q == ANYWHERE), more, np.abs(p - q) + np.abs((a - p) - (b - q))) <= k
    return near & (np.bitwise_count(x ^ y).sum(axis=0, dtype=np.int64) <= 2 * k - more)


def _bucket_pairs(n: np.ndarray, place: np.ndarray, odd: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs of rows of one bucket that may be linked, or None if they are more than MOST; rows ascend by number of words."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total, size = 0, len(n)
    most = np.minimum(2 * edits[n], 255).astype(np.uint8)
    end = np.searchsorted(n - edits[n], n, "right")  # a longer line further on needs too many words more
    end = np.maximum.accumulate(end)
    for lo in range(0, size, 128):
        hi = min(lo + 128, size)
        j = slice(lo, int(end[hi - 1]))
        apart = np.bitwise_count(odd[0, lo:hi, None] ^ odd[0, j]) + np.bitwise_count(odd[1, lo:hi, None] ^ odd[1, j])
        x, y = np.nonzero(apart <= most[j])
        x, y = x + lo, y + lo
        x, y = x[x < y], y[x < y]
        ok = _meets((n[x], n[y]), (place[x], place[y]), (odd[:, x], odd[:, y]), edits)
        found.append((x[ok], y[ok]))
        total += len(found[-1][0])
        if total > MOST:
            return None
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _parts(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``size`` rows the least one that pairs x, y join it with."""
    label = np.arange(size)
    while True:
        lower = label.copy()
        np.minimum.at(lower, x, label[y])
        np.minimum.at(lower, y, label[x])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def bring_together(key: np.ndarray, of: np.ndarray, n: np.ndarray, place: np.ndarray, odd: np.ndarray, odd2: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in any order the pairs that small buckets give, and the rows of larger or meshed buckets with their buckets' numbers, ascending."""
    row = np.argsort(key)
    rank = np.cumsum(np.diff(key[row], prepend=key[row[:1]]) != 0)
    # an occurrence of each line by key and number of words; the others are equal to it
    row = row[np.lexsort((of[row], rank << 32 | n[row]))]
    k, o = key[row], of[row]
    row = row[np.append([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))] if len(row) else row
    k = key[row]
    first = np.flatnonzero(np.append([True], k[1:] != k[:-1])) if len(row) else row
    size = np.diff(np.append(first, len(row)))
    n, place, odd = n[row].astype(np.int64), place[row].astype(np.int64), np.stack((odd[row], odd2[row]))
    edits = most_edits(np.arange(n.max(initial=0) + 1), least)
    bucket = np.where(np.repeat(size > SMALL, size), np.repeat(first, size), -1)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(size[(size > 1) & (size <= min(TINY, SMALL))]).tolist():
        heads = first[size == s]
        i, j = np.triu_indices(s, 1)
        for x in range(0, len(heads), step := max(1, (1 << 18) // len(i))):
            at = heads[x : x + step, None]
            i_at, j_at = (at + i).ravel(), (at + j).ravel()
            ok = _meets((n[i_at], n[j_at]), (place[i_at], place[j_at]), (odd[:, i_at], odd[:, j_at]), edits)
            left.append(row[i_at[ok]])
            right.append(row[j_at[ok]])
    for at, s in zip(*(v[(size > min(TINY, SMALL)) & (size <= ALL_PAIRS)].tolist() for v in (first, size)), strict=True):
        own = slice(at, at + s)
        bucket[own] = at
        pairs = _bucket_pairs(n[own], place[own], odd[:, own], edits)
        if pairs is None:
            continue
        x, y = pairs
        if s > SMALL:
            bucket[own] = at + _parts(s, x, y)
        elif len(x) > MESHED * s or len(x) > TINY * TINY:
            label = _parts(s, x, y)
            meshed = np.bincount(label[x], minlength=s) > MESHED * np.bincount(label, minlength=s)
            bucket[own] = np.where(meshed[label], at + label, -1)
            x, y = x[~meshed[label[x]]], y[~meshed[label[x]]]
        else:
            bucket[own] = -1
        if s <= SMALL:
            left.append(row[at + x])
            right.append(row[at + y])
    at = np.flatnonzero(bucket >= 0)
    at = at[np.bincount(bucket[at], minlength=1)[bucket[at]] > 1]
    at = at[np.argsort(bucket[at], kind="stable")]
    return np.concatenate(left), np.concatenate(right), row[at], bucket[at]


def groups(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows in buckets of two or more: their numbers, the least member, the member to compare with, and the bucket's size."""
    first = np.flatnonzero(np.append([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    bucket = np.repeat(np.arange(len(first)), size)
    order = np.lexsort((of, bucket))
    n = size[bucket]
    inside = np.arange(len(key)) - first[bucket]
    lead = of[order][first[bucket]] if len(key) else of
    # a part of FAN members has a leader of its own, and this one is compared with the bucket's
    head = first[bucket] + inside // FAN * FAN
    via = np.where(inside % FAN == 0, lead, of[order][head] if len(key) else of)
    ok = n > 1
    return order[ok], lead[ok], via[ok], n[ok]


def distance(a: Sequence, b: Sequence, most: int) -> int:
    """The edit distance of two sequences by bit-parallel columns; any number over ``most`` if it is larger."""
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    j = 0
    while j < end - k and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[k : len(a) - j], b[k : len(b) - j]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    m = len(a)
    if not len(b):
        return m
    where: dict = {}
    bit = 1
    for c in a:
        where[c] = where.get(c, 0) | bit
        bit <<= 1
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    left = len(b)
    for c in b:
        eq = where.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | (~(d0 | plus) & full)
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        left -= 1
        if score - left > most:
            return most + 1
        up = ((up << 1) | 1) & full
        plus = ((down << 1) | (~(d0 | up) & full)) & full
        minus = up & d0
    return score


def near(a: list[bytes], b: list[bytes], least: float, in_a: set[bytes] | None = None, in_b: set[bytes] | None = None) -> bool:
    """Whether two lists of words have an edit similarity of ``least``; in_a and in_b may give their sets."""
    n = max(len(a), len(b))
    most = int(round((1 - least) * n, 9))
    in_a, in_b = in_a or set(a), in_b or set(b)
    # words in common, repeats of a's included, are at least those that stay in place
    if n - (len(in_a & in_b) + len(a) - len(in_a)) > most:
        return False
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    j = 0
    while j < end - k and a[-1 - j] == b[-1 - j]:
        j += 1
    # what is left can be replaced word by word, or is compared
    return n - k - j <= most or distance(a[k : len(a) - j], b[k : len(b) - j], most) <= most


def _read(notes: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of normalised lines, their numbers, and their counts by cell."""
    words = [x.split(b" ") for x in notes]
    ends = np.cumsum([len(x) for x in notes], dtype=np.int64)
    data = np.frombuffer(b"".join(notes), np.uint8)
    s, e, of = X.words(data, np.append([0], ends))
    cell = of * CELLS + (X.span_hash(data, s, e) >> np.uint64(40)).astype(np.int64) % CELLS
    return words, np.array([len(w) for w in words], np.int64), np.bincount(cell, minlength=len(notes) * CELLS).reshape(-1, CELLS).astype(np.int32)


def _possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether counts by cell and numbers of words allow a link: a changed word moves two counts, another edit one."""
    more, k = np.abs(n - m), most_edits(np.maximum(n, m), least)
    return (more <= k) & (np.abs(a - b).sum(axis=-1, dtype=np.int64) <= 2 * k - more)


class _Edit(Search):
    """Links by edit similarity: notes are normalised lines."""

    def __init__(self, least: float):
        self.least = least

    def prepare(self, notes: pa.ChunkedArray):
        words, n, cells = _read(notes.to_pylist())
        return cells, n, words, [set(w) for w in words]

    def find(self, ready, i: int, j: np.ndarray) -> np.ndarray:
        cells, n, _, _ = ready
        return _possible(cells[j], cells[i], n[j], n[i], self.least)

    def test(self, ready, i: int, k: int) -> bool:
        words, sets = ready[2:]
        return near(words[i], words[k], self.least, sets[i], sets[k])


def frequent_words(docs: DataFrame, min_words: int) -> np.ndarray:
    """The table of rarity() of the most frequent words and pairs of neighbouring words in a sample of (doc_id, th, text)."""

    def count(batches):
        for b in batches:
            for _, _, data, offs in X.chunks(b.column(0)):
                pair, _, left, right = pair_hashes(*_split(data, offs, min_words)[:3])
                u, n = np.unique(np.concatenate((pair, right, left[left == 2])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["pair", "n"])

    some = docs.filter(F.pmod(F.xxhash64("th", "doc_id"), F.lit(max(1, docs.count() // SAMPLE))) == 0).limit(2 * SAMPLE).select("text")
    got = some.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "pair").limit(FREQUENT).toArrow()
    return rarity(got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy())


def _pack(key: np.ndarray, *rest: np.ndarray) -> bytes:
    """Rows sorted by key: steps between the keys' upper 48 bits, and the byte planes of all numbers."""
    step = np.diff(key >> np.uint64(16), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).ravel() for x, kind in zip((step, *rest), KINDS, strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [int(kind[2:]) for kind in KINDS]
    rows, out, at = len(raw) // sum(widths), [], 0
    for kind, width in zip(KINDS, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + width * rows].reshape(width, rows).T).view(kind).ravel())
        at += width * rows
    return np.cumsum(out[0], dtype=np.uint64), *out[1:]


def candidates(docs: DataFrame, least: float, min_words: int) -> DataFrame:
    """(a, b, key, lead, n): pairs a, b of different lines that may be linked, n is 2; and the members a of larger buckets, each with b to be compared with.

    Keys travel packed, a row for each task and bucket.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.sparkContext.broadcast(frequent_words(docs, min_words))

    def keyed(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            order = np.argsort(rows[0])
            rows = [x[order] for x in rows]
            # the bucket grows with the key, so sorted keys are sorted by bucket
            bucket = ((rows[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.append([True], bucket[1:] != bucket[:-1]))
            parts = [_pack(*(x[a:e] for x in rows)) for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(parts, pa.binary())], names=["bucket", "part"])

        for b in batches:
            for _, _, data, offs in X.chunks(b.column(0), CHUNK):
                rows = line_keys(data, offs, least, table.value, min_words)
                if len(rows[0]):
                    held.append(rows)
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()
        X.trim()

    def meet(t: pa.Table) -> pa.Table:
        rows = [np.concatenate(x) for x in zip(*map(_unpack, t.column("part").to_pylist()), strict=True)]
        key = rows[0]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        shared = np.zeros(len(order), bool)
        shared[1:] |= same
        shared[:-1] |= same
        at = order[shared]
        rows = [x[at] for x in rows]
        key, of = rows[:2]
        a, b, at, bucket = bring_together(*rows, least)
        pairs = np.unique(np.stack((np.minimum(of[a], of[b]), np.maximum(of[a], of[b])), axis=1), axis=0)
        key, own = key[at], of[at]
        at, lead, via, size = groups(bucket, own)
        # a bucket of a key is known by its least line; rows without a key are pairs
        mark = X.mix(key[at] ^ X.mix(lead.view(np.uint64))).view(np.int64)
        out = {"a": (pairs[:, 0], own[at]), "b": (pairs[:, 1], via), "key": (np.zeros(len(pairs), np.int64), mark), "lead": (np.zeros(len(pairs), np.int64), lead), "n": (np.full(len(pairs), 2), size)}
        X.trim()
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    parts = docs.select("text").mapInArrow(keyed, "bucket long, part binary")
    return parts.groupBy("bucket").applyInArrow(meet, "a long, b long, key long, lead long, n long")


def duplicates(docs: DataFrame, least: float, min_words: int, exact_words: int) -> DataFrame:
    """(doc_id, th, line): the occurrences to take out of documents (doc_id, th, text)."""
    if least < 0.5:  # edits could take all pairs of words
        raise ValueError("least must be 0.5 or more")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batches):
        for b in batches:
            for i, _, data, offs in X.chunks(b.column("text")):
                _, _, _, doc, line, h = _split(data, offs, min(exact_words, min_words))
                if len(doc):
                    at = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), pa.array(line), pa.array(h)], names=["doc_id", "th", "line", "id"])
            X.trim()

    found = stash(candidates(docs, least, min_words), "buckets")
    lines = stash(docs.mapInArrow(mark, f"doc_id {kind}, th long, line long, id long"), "lines")
    pairs = stash(found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    def fetch(ids: DataFrame) -> DataFrame:
        """(id, note): normalised lines of ids, each from one occurrence."""
        place = lines.join(ids, "id").groupBy("id").agg(F.min(F.struct("doc_id", "th", "line")).alias("at"))
        asks = place.groupBy(F.col("at.doc_id").alias("d"), F.col("at.th").alias("h")).agg(F.collect_list(F.struct("id", "at.line")).alias("asks"))
        both = packed(docs, level=1).join(asks, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("z", "asks")

        def cut(batches):
            unpack = zstandard.ZstdDecompressor()
            for whole in batches:
                for k in range(0, whole.num_rows, 128):  # texts grow when they are opened, and have many lines
                    b = whole.slice(k, 128)
                    ids, notes = [], []
                    for z, asked in zip(b.column("z"), b.column("asks").to_pylist(), strict=True):
                        own = unpack.decompress(z.as_buffer()).split(b"\n")
                        for x in asked:
                            ids.append(x["id"])
                            notes.append(normal(own[x["line"]]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(notes, pa.binary())], names=["id", "note"])
                X.trim()

        # a document that is there twice gives its lines twice, which adds no link
        return both.mapInArrow(cut, "id long, note binary")

    def verify(pairs: DataFrame, found: DataFrame) -> DataFrame:
        both = pairs.join(found.select(F.col("id").alias("a"), F.col("note").alias("na")), "a").join(found.select(F.col("id").alias("b"), F.col("note").alias("nb")), "b")

        def test(batches):
            for t in batches:
                ok = [near(x.split(b" "), y.split(b" "), least) for x, y in zip(t.column("na").to_pylist(), t.column("nb").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return both.select("a", "b", "na", "nb").mapInArrow(test, "a long, b long")

    larger = found.filter("n >= 3").select("key", F.col("a").alias("id"), "lead", "n")
    comps = link(pairs, larger, fetch, verify, _Edit(least))
    # lines that no other is like go before anything is ordered
    group = F.coalesce("comp", "id").alias("group")
    there = lines.join(comps, "id", "left").select("doc_id", "th", "line", group)
    firsts = there.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "line")).alias("first")).filter("n > 1")
    there = there.join(firsts.select("group", "first"), "group")
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")) & (F.col("first.line") == F.col("line"))
    return there.filter(~same).select("doc_id", "th", "line")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8, min_words: int = MIN_WORDS, exact_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text``, and columns n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text")
    gone = duplicates(own, least, min_words, exact_words).groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines")).select(F.struct("doc_id", "th").alias("of"), "lines")
    # the input travels as one struct, so its names may be any
    full = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    of, cell = F.col("row").getField(key), F.col("row").getField(text)
    full = full.withColumn("th", F.xxhash64(F.coalesce(cell, F.lit(""))))
    full = full.join(gone, of.eqNullSafe(F.col("of.doc_id")) & (F.col("th") == F.col("of.th")), "left")
    split = F.split(cell, "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("lines", i.cast("long"))), "\n")
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: x != "")), F.lit(0)).cast("long").alias("n_lines")
    n_removed = F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed")
    new = F.when(F.col("lines").isNull(), cell).otherwise(kept)
    return full.select(*((new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns), n_lines, n_removed)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: what every document keeps of its lines, as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, exact_words=1).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
