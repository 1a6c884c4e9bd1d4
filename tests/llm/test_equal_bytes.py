"""Different bytes stay different, also where a polynomial hash takes them for equal."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest

from quantloom.llm import _text as X
from quantloom.llm import bpe, lines, minhash, rules

SWAP = str.maketrans("ab", "ba")


def thue(n: int) -> str:
    out = "a"
    for _ in range(n):
        out += out.translate(SWAP)
    return out


ONE, TWO = thue(10), thue(10).translate(SWAP)


def spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) for x in parts])
    return np.frombuffer(b"".join(parts), np.uint8), ends - [len(x) for x in parts], ends


def test_distinct_spans_are_told_by_bytes(monkeypatch):
    r = np.random.default_rng(1)
    parts = [bytes(r.integers(97, 99, r.integers(0, 12)).astype(np.uint8)) * int(r.choice([1, 1, 9])) for _ in range(4000)]
    for weak in (False, True):
        if weak:  # a hash that collides all the time changes nothing
            monkeypatch.setattr(X, "span_hash", lambda data, a, e: ((e - a) % 5).astype(np.uint64))
        first, own = X.distinct_spans(*spans(parts))
        assert len(first) == len(set(parts)) and all(parts[first[k]] == x for k, x in zip(own, parts, strict=True))


def test_hash_depends_on_the_bytes_alone():
    parts = [b"abc", b"", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"abc", b"abc\0"]
    h = X.span_hash(*spans(parts))
    assert h[0] == h[6] and len(set(h.tolist())) == 7
    again = X.span_hash(*spans([b"shift", *parts[::-1]]))
    assert again[1:][::-1].tolist() == h.tolist()


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, ONE), (2, TWO)], "doc_id long, text string").coalesce(1)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_decodes_both(pair):
    got = {r.doc_id: r.decoded_sha256 for r in bpe.encode(pair, ranks_path()).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((1, ONE), (2, TWO))}


def test_rank_files_of_one_session_do_not_mix(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    full = ranks_path()
    small = str(tmp_path / "few.tiktoken")
    with open(full, "rb") as f, open(small, "wb") as g:
        g.writelines(f.readlines()[:1000])
    text = "several words that have longer tokens in one of the files"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    for path in (full, small, full):
        ranks = bpe.load_ranks(path)
        want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
        assert bpe.encode(df, path, with_ids=True).first().ids == want
    assert base64.b64encode(b"a")  # the file's format


def test_rules_count_lines_by_bytes(spark):
    got = rules.judge(spark.createDataFrame([(1, f"{ONE}\n{TWO}\n{ONE}")], "doc_id long, text string")).first()
    assert got.n_dup_lines == 1
    window = " ".join("abcd")
    got = rules.judge(spark.createDataFrame([(1, f"{ONE} {window} x {TWO} {window} y {ONE} {window}")], "doc_id long, text string")).first()
    assert got.n_repeat_words == 10


def test_minhash_and_lines_keep_both(pair):
    assert [r.component_id for r in sorted(minhash.dedup(pair, size=2).collect())] == [1, 2]
    assert [r.n_removed for r in lines.dedup(pair, exact_words=1).collect()] == [0, 0]
    mark = lines.line_marks(np.frombuffer(f"{' '.join(ONE)}\n{' '.join(TWO)}".encode(), np.uint8), np.array([0, 4095]))[2]
    assert mark[0] != mark[1]  # a line is known by its words in order


def test_chunks_reach_the_end_of_the_text():
    import random

    import zstandard

    pack = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    r = random.Random(4)
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(1200)).encode()
    junk = prose[: 3 * 2048] + b"z" * 2000
    assert len(rules.ratios(prose[:2047], pack, 2048)[1]) == 0 and len(rules.ratios(prose[:2048], pack, 2048)[1]) == 1
    found = rules.ratios(junk, pack, 2048)[1]
    assert len(found) == 4 and found[-1] < 0.1
