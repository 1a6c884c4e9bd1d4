"""The ten operators against brute force on small fixtures, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import _graph, bpe, crosspoly, lines, minhash, mixing, quality, rules, suffix, toxicity, urls
from quantloom.llm import _text as X

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, size int, note string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split(" "))


def corpus() -> list[str | None]:
    base = [prose(RNG.randint(20, 200), k) for k in range(12)]
    out: list[str | None] = [None, "", " \n\t ", "one", "one", "two words", "a b c d", "x" * 5000, "é ñ 中文   'll don't", "spam " * 400]
    out += base + base[:4] + [edited(base[k % 4], 0.02 * (k % 5), 100 + k) for k in range(30)]
    out += ["\n".join([base[5], f"line {k} of its own with words", base[6][:150], ""]) for k in range(6)]
    return out


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), True, 0.5, 7, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(t: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", t or "")


# --- op10 ---------------------------------------------------------------------------------------------------------


def test_rules_count_like_the_definition(docs, texts):
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for k, t in enumerate(texts):
        w, r = words(t), got[k]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        seen: set[str] = set()
        dup = 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert r.n_dup_lines == dup
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = {g for g, c in Counter(grams).items() if c > 1}
        covered = {i + j for i, g in enumerate(grams) if g in many for j in range(5)}
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert not got[9].kept and got[9].note == "x"


def test_rules_reject_noise_and_repeats_only(spark):
    noise = " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:16].upper() + chr(33 + k % 90) for k in range(400))
    import base64

    r = random.Random(1)
    raw = " ".join(base64.b64encode(bytes(r.randrange(256) for _ in range(12))).decode() for _ in range(400))
    rows = [(0, prose(500, 1)), (1, ("same words again " * 300)), (2, raw)]
    got = {x.doc_id: x.band_failed for x in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[0] and got[1] and got[2]
    assert noise


# --- op2 ----------------------------------------------------------------------------------------------------------


def components_of(n: int, links) -> list[int]:
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_finds_all_links(docs, texts, size):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = words((t or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components_of(len(sets), links)
    got = {r.doc_id: r for r in minhash.dedup(docs, size=size).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), want[k], want[k] == k)


def test_registers_estimate_similarity():
    r = np.random.default_rng(0)
    a = np.sort(r.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2))
    b = np.sort(np.concatenate((a[:1600], r.integers(0, 1 << 63, 400).astype(np.uint64))))
    ra, rb = (minhash.registers(x, np.array([0, len(x)]))[0] for x in (a, b))
    assert abs((ra == rb).mean() - 1600 / 2400) < 0.2
    assert (minhash.registers(a[:1], np.array([0, 1]))[0] == minhash.registers(a[:1], np.array([0, 1]))[0][0]).all()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.id: r.comp for r in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and all(got[k] == 100 for k in range(100, 160)) and got[300] == 200


# --- op4 ----------------------------------------------------------------------------------------------------------


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(2)
    for _ in range(500):
        a, b = (bytes(r.choice(b"abc") for _ in range(r.randint(0, 15))) for _ in range(2))
        assert min(lines.distance(a, b, 6), 7) == min(plain(a, b), 7)


def test_lines_keep_one_occurrence(spark):
    one = "The quick brown fox jumps over the lazy dog near the river bank today and sleeps well afterwards"
    near = one.replace("today", "todax").upper() + "!"
    rows = [(1, f"{one}\nfresh words that stay where they are"), (2, f"short one\n{near}\nshort one"), (3, one), (3, one), (4, None), (5, ""), (None, "another line that has enough words here"), (6, "another line, that has enough words here")]
    got = lines.dedup(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_lines string")).collect()
    by = {r.doc_id: r for r in got if r.doc_id}
    assert len(got) == len(rows)
    assert by[1].n_removed == 0 and by[2].text == "short one\nshort one" and by[3].text == "" and by[4].text is None and by[6].text == ""
    assert [r.text for r in got if r.doc_id is None] == ["another line that has enough words here"]


def test_exact_line_repeats_go(docs, texts):
    got = {r.doc_id: r for r in lines.dedup(docs).collect()}
    seen: set[bytes] = set()
    for k, t in enumerate(texts):
        for line in (t or "").encode().split(b"\n"):
            n = lines.normal(line)
            if len(n.split()) >= 5:
                if n in seen:
                    assert line.decode() not in (got[k].text or "").split("\n")
                seen.add(n)


def changed(line: list[str], edits: int, r: random.Random) -> list[str]:
    """``line`` after so many changed, new or lost words."""
    out = list(line)
    for _ in range(edits):
        k, what = r.randrange(len(out)), r.random()
        if what < 0.6:
            out[k] = r.choice(WORDS)
        elif what < 0.8:
            out.insert(k, r.choice(WORDS))
        else:
            del out[k]
    return out


def near_lines(lengths: list[int], seed: int) -> list[str]:
    r = random.Random(seed)
    out = []
    for n in lengths:
        line = [r.choice(WORDS) for _ in range(n)]
        out += [" ".join(x) for x in [line] + [changed(line, r.randint(1, max(1, n // 4)), r) for _ in range(3)]]
    return list(dict.fromkeys(x for x in out if len(x.split()) >= 5))


def line_links(texts: list[str]) -> list[tuple[int, int]]:
    """All pairs of lines within the limit, by plain comparison."""
    own = [x.split() for x in texts]
    out = []
    for i, a in enumerate(own):
        for j in range(i):
            most = round(0.2 * max(len(a), len(own[j])), 9) // 1
            if abs(len(a) - len(own[j])) <= most and lines.distance(a, own[j], int(most)) <= most:
                out.append((j, i))
    return out


@pytest.mark.parametrize("known", [False, True])
def test_lines_within_the_limit_meet(known, monkeypatch):
    texts = near_lines([n for n in range(5, 64) for _ in range(4)], 8)
    links = line_links(texts)
    assert len(links) > 300
    data = "\n".join(texts).encode()
    raw, offs = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    pairs, n = np.unique(lines.pair_hashes(*lines._split(raw, offs, 5)[:3])[0], return_counts=True)
    table = lines.rarity(pairs[n > 1], n[n > 1]) if known else lines.rarity(pairs[:0], n[:0])
    _, at, mark, size, cells = lines.line_marks(raw, offs)
    assert at.tolist() == list(range(len(texts)))
    rows = lines.line_keys(raw, offs, 0.8, table)
    order = np.argsort(rows[0])
    rows = [x[order] for x in rows]
    back = lines._unpack(lines._pack(*rows))
    assert (back[0] == rows[0] >> np.uint64(16)).all() and all((x == y).all() for x, y in zip(back[1:], rows[1:], strict=True))
    want = {tuple(sorted((int(mark[i]), int(mark[j])))) for i, j in links}
    for small in (64, 1):
        monkeypatch.setattr(lines, "SMALL", small)
        a, b, at, bucket = lines.bring_together(*rows, 0.8)
        met = {tuple(sorted((int(x), int(y)))) for x, y in zip(rows[1][a], rows[1][b], strict=True)}
        assert bool(met) == (small > 1)
        own: dict[int, list[int]] = {}
        for k, x in zip(at.tolist(), bucket.tolist(), strict=True):
            own.setdefault(x, []).append(int(rows[1][k]))
        met |= {tuple(sorted(pair)) for x in own.values() for pair in combinations(x, 2)}
        assert want <= met
    i, j = np.array(links).T
    counts = lines.cell_counts(cells)
    assert (counts.sum(axis=1) == size).all() and lines._possible(counts[i], counts[j], size[i], size[j], 0.8).all()
    words, size, cells = lines._read([x.encode() for x in texts])
    assert [len(w) for w in words] == size.tolist() and lines._possible(cells[i], cells[j], size[i], size[j], 0.8).all()


def lettered(k: int) -> str:
    """A word of its own for each number; digits are all the same to lines."""
    return "w" + "".join("abcdefghij"[int(c)] for c in str(k))


def keys_of(texts: list[str]) -> list[np.ndarray]:
    data = "\n".join(texts).encode()
    return list(lines.line_keys(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0.8, lines.rarity(np.zeros(0, np.uint64), np.zeros(0, np.int64))))


def test_lines_are_numbered_in_their_documents():
    r = np.random.default_rng(0)
    letters = np.frombuffer(b"ab c\n\n\t,.;1-\r A", np.uint8)
    for _ in range(200):
        offs = np.concatenate(([0], np.cumsum(r.integers(0, 40, r.integers(1, 6)))))
        data = letters[r.integers(0, len(letters), offs[-1])]
        plain = [(k, i, len(words)) for k in range(len(offs) - 1) for i, line in enumerate(data[offs[k] : offs[k + 1]].tobytes().split(b"\n")) if (words := [w for w in lines.normal(line).split(b" ") if w])]
        _, first, last, doc, line, _ = lines._split(data, offs, 1)
        assert list(zip(doc.tolist(), line.tolist(), (last - first).tolist(), strict=True)) == plain


def test_unrelated_lines_of_a_common_pair_end_in_their_bucket():
    r = random.Random(5)
    texts = [" ".join([lettered(r.randrange(9000)) for _ in range(20)]) for _ in range(400)]
    texts += [" ".join([*texts[k].split()[:19], "other"]) for k in range(0, 400, 40)]
    rows = keys_of(texts)
    rows[0] = np.zeros_like(rows[0])  # one bucket of all lines, each at its first place
    rows[3] = np.full_like(rows[3], lines.ANYWHERE)
    a, b, at, _ = lines.bring_together(*rows, 0.8)
    assert not len(at)  # no line goes on to a leader or into blocks
    assert sorted({tuple(sorted((int(rows[1][i]), int(rows[1][j])))) for i, j in zip(a, b, strict=True)}) == sorted(
        tuple(sorted((int(x), int(y)))) for x, y in ((keys_of([texts[i]])[1][0], keys_of([texts[j]])[1][0]) for i, j in line_links(texts))
    )


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_meshed_lines_are_not_expanded(most, monkeypatch):
    monkeypatch.setattr(lines, "MOST", most)
    r = random.Random(6)
    line = [lettered(k) for k in range(40)]
    texts = list(dict.fromkeys(" ".join(changed(line, 2, r)) for _ in range(300)))
    texts += [" ".join(lettered(1000 + r.randrange(9000)) for _ in range(40)) for _ in range(200)]
    rows = keys_of(texts)
    rows[0], rows[3] = np.zeros_like(rows[0]), np.full_like(rows[3], lines.ANYWHERE)
    a, _, at, bucket = lines.bring_together(*rows, 0.8)
    assert len(a) == 0 and len(set(bucket.tolist())) == 1
    # the copies alone stay together, or the whole bucket if its pairs are too many to hold
    assert len(at) == len(set(rows[1][at].tolist())) == (len(texts) - 200 if most > 50 else len(texts))


def test_joined_components_meet_again(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (8, 9)], "a long, b long")
    larger = spark.createDataFrame([(7, i, 2, 5) for i in (2, 4, 6, 10, 11)], "key long, id long, lead long, n long")

    class Near(lines.Search):
        def prepare(self, notes):
            return notes.to_pylist()

        def find(self, ready, i, j):
            return np.array([ready[k] == ready[i] for k in j.tolist()])

    notes = {2: b"x", 4: b"x", 6: b"y", 10: b"x", 11: b"z"}
    fetch = lambda ids: ids.select("id").toDF("id").rdd.map(lambda r: (r.id, notes.get(r.id, b"?"))).toDF("id long, note binary")
    got = {r.id: r.comp for r in lines.link(pairs, larger, fetch, lambda p, _: p, Near()).collect()}
    assert {k: got.get(k, k) for k in (*range(1, 7), *range(8, 12))} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 8, 9: 8, 10: 1, 11: 11}


def test_large_buckets_are_dealt_in_parts():
    key = np.repeat(np.array([3, 5, 9], np.uint64), [1, 1200, 2])
    of = np.random.default_rng(0).permutation(len(key)).astype(np.int64)
    at, lead, via, n = lines.groups(key, of)
    assert sorted(at.tolist()) == list(range(1, len(key)))
    for k in (5, 9):
        own = key[at] == k
        ids = of[at][own]
        assert (lead[own] == ids.min()).all() and (n[own] == own.sum()).all() and set(via[own]) <= set(ids)
        assert np.unique(via[own], return_counts=True)[1].max() <= lines.FAN + 3
        top = dict(zip(ids.tolist(), via[own].tolist(), strict=True))
        assert all(top[top[i]] == ids.min() for i in ids.tolist())


def test_lines_link_like_all_pairs(spark):
    texts = near_lines([5, 5, 6, 8, 9, 10, 12, 15, 19, 20, 24, 30, 40, 60] * 4, 9)
    # two lines with more variants than a small bucket takes; copies of copies drift apart
    r = random.Random(4)
    for n in (24, 40):
        line = [r.choice(WORDS) for _ in range(n)]
        for k in range(90):
            texts.append(" ".join(changed(line, r.randint(1, n // 3), r)))
            if k % 30 == 29:
                line = changed(line, n // 4, r)
    texts = list(dict.fromkeys(texts))
    want = components_of(len(texts), line_links(texts))
    got = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == {k for k in range(len(texts)) if want[k] == k}


def test_equal_lines_of_any_length_go(spark, tmp_path):
    rows = [(1, "All rights reserved.\n\n***\n你好世界"), (2, "all rights reserved\n\n***\n你好世界\nmore"), (3, "more"), (4, "all rights kept")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in lines.query(spark, str(tmp_path)).collect()}
    want = {1: (0, rows[0][1]), 2: (2, "\n***\nmore"), 3: (1, ""), 4: (0, "all rights kept")}
    assert got == {k: (n, hashlib.sha256(t.encode()).hexdigest()) for k, (n, t) in want.items()}


# --- op5 ----------------------------------------------------------------------------------------------------------


def test_maximal_repeats_by_brute_force():
    r = random.Random(3)
    for _ in range(25):
        n = r.choice([3, 5, 8])
        base = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(3)]
        own = ["".join(r.choice(base)[: r.randint(0, 30)] + r.choice("abc") for _ in range(3)).encode() for _ in range(4)]
        places: dict[bytes, list] = {}
        for k, t in enumerate(own):
            for i in range(len(t)):
                for j in range(i + n, len(t) + 1):
                    places.setdefault(t[i:j], []).append((k, i))
        want = {}
        for w, at in places.items():
            left = {own[k][i - 1 : i] or (k, i) for k, i in at}
            right = {own[k][i + len(w) : i + len(w) + 1] or (k, i) for k, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[w] = sorted(at)
        assert dict(suffix.maximal_repeats(own, n)) == want


@pytest.mark.parametrize("together", [1024, 1])
def test_repeated_bytes_go(docs, texts, together, monkeypatch):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    got = {r.doc_id: r for r in suffix.remove(docs).collect()}
    for k, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(np.diff(np.append([0], gone.astype(int))).clip(0).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[: len(t)]]) if t else b""
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(t), int(gone.sum()), spans, kept)


# --- op6 ----------------------------------------------------------------------------------------------------------


def test_embeddings_by_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(6, 16))
    v = np.concatenate([base[k % 6] + r.normal(size=(1, 16)) * 0.02 * (k % 7) for k in range(120)])
    rows = [(k, v[k].tolist(), k % 2) for k in range(120)] + [(120, None, 0), (121, [0.0] * 16, 0), (122, [float("nan")] + [1.0] * 15, 0), (123, v[0].tolist(), None), (124, v[0].tolist(), 0), (125, v[0, :8].tolist(), 0)]
    got = {x.vec_id: x for x in crosspoly.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(k, np.array(e), y) for k, e, y in rows if e and y is not None and np.isfinite(e).all() and any(e)]
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a[0], b[0]) for i, a in enumerate(good) for b in good[:i] if a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.98]
    want, n = components_of(len(rows), links), Counter(x for pair in links for x in pair)
    assert len(got) == len(rows)
    for k in range(len(rows)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (n[k], want[k], want[k] == k)


# --- op7 ----------------------------------------------------------------------------------------------------------


def test_targets_fill_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 5000), ("c", 300), (None, 900)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 200 and got["c"] == 600  # weights 3, 1, 2, 3: small sources stop at twice their size
    assert np.isclose(sum(got.values()), 1.5 * 6300) and got[None] == 1800 and np.isclose(got["b"], 1.5 * 6300 - 2600)


def test_mix_comes_near_its_targets(spark):
    r = random.Random(6)
    rows = [(k, " ".join(["w"] * r.randint(0, 60)), r.choice(["x", "y", "z", None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(mixing.mix(df).collect())
    assert one == sorted(mixing.mix(df.repartition(5)).collect())
    by = pd.DataFrame(one, columns=["doc_id", "size", "source_size", "target", "taken"])
    assert (by.taken <= 2 * by["size"]).all() and len(by) == 3000
    for _, g in by.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60 and g["size"].sum() == g.source_size.iloc[0]


# --- op8 ----------------------------------------------------------------------------------------------------------


def test_bpe_is_what_tiktoken_gives(docs, texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(docs, path, block_bytes=4096, with_ids=True).collect()}
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[k].ids == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_pretokens_are_the_pattern():
    import public_tokenizers
    import regex

    r = random.Random(1)
    own = ["".join(r.choice("ab'sstrevelld  \n\t12.,!é ñ中 '’\x1c\x85\xa0 ") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for i, j, data, offs in X.chunks(pa.array(own), 20000):
        s, e, d = bpe.pretokens(data, offs)
        found: dict[int, list[str]] = {}
        for a, b, k in zip(s, e, d, strict=True):
            found.setdefault(k, []).append(data[a:b].tobytes().decode())
        for k in range(j - i):
            assert found.get(k, []) == regex.findall(public_tokenizers.PATTERN, own[i + k])


# --- op3, op9 -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_holds_out(spark, labelled):
    got = quality.query(spark, "/root/testdata/sf0.01").join(labelled[1], "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.9 and (bad.predicted == 0).mean() > 0.7


def test_toxicity_holds_out(spark, labelled):
    got = toxicity.query(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
    assert len(toxic) > 50 and (clean.predicted == 0).mean() > 0.95 and (toxic.predicted == 1).mean() > 0.8


def test_nearest_is_exact(monkeypatch):
    r = np.random.default_rng(0)
    index = toxicity.Index(np.arange(30, dtype=np.uint64), np.ones(30), 0.1)
    dense = np.where(r.random((300, 30)) < 0.15, r.random((300, 30)), 0.0)
    norm = np.sqrt((dense**2).sum(axis=1))
    dense = dense / np.where(norm > 0, norm, 1)[:, None]
    index.weights = [{int(t): float(row[t]) for t in np.flatnonzero(row)} for row in dense]
    index.toxic = np.zeros(300)
    index.build()
    for few, block in ((1536, 512), (7, 16), (0, 3)):  # frequent terms as a matrix, some of them, none
        monkeypatch.setattr(toxicity, "DENSE", few)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        index.__dict__.pop("_by_term", None)
        asked = [(np.flatnonzero(q), q[np.flatnonzero(q)]) for q in dense[:100]]
        for q, (got, cos) in zip(dense, index.nearest(asked), strict=False):
            every = dense @ q
            assert len(got) == min(15, (every > 0).sum()) and np.allclose(cos, np.sort(every)[::-1][: len(got)], atol=1e-6)
            assert np.allclose(every[got], cos, atol=1e-6)


def test_nearest_compares_few_examples(monkeypatch):
    r = np.random.default_rng(1)
    n, terms = 3000, 400
    tf = r.poisson(np.minimum(3, 40 / np.arange(1, terms + 1)), (n, terms))
    idf = np.log(n / (1 + (tf > 0).sum(axis=0))) + 0.05
    dense = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * idf, 0)
    dense /= np.sqrt((dense**2).sum(axis=1))[:, None]
    index = toxicity.Index(np.arange(terms, dtype=np.uint64), idf, 0.1, np.zeros(n))
    index.weights = [{int(t): float(row[t]) for t in np.flatnonzero(row)} for row in dense]
    index.build()
    asked = [(np.flatnonzero(q), q[np.flatnonzero(q)]) for q in dense[:80]]
    compared, cosines = [], toxicity.Index._cosines
    monkeypatch.setattr(toxicity.Index, "_cosines", lambda self, known, whole, examples: compared.append(len(examples)) or cosines(self, known, whole, examples))
    for most in (toxicity.DENSE, 50):
        monkeypatch.setattr(toxicity, "DENSE", most)
        for product in (toxicity._multiply, lambda a, b: a.astype(np.float32) @ b.astype(np.float32)):  # with onnxruntime and without
            monkeypatch.setattr(toxicity, "_multiply", product)
            index.__dict__.pop("_by_term", None)
            compared.clear()
            for q, (got, cos) in zip(dense, index.nearest(asked), strict=False):
                every = dense @ q
                assert np.allclose(cos, np.sort(every)[::-1][:15], atol=1e-6) and np.allclose(every[got], cos, atol=1e-6)
            assert index._inverted()[4].dtype == np.int8 and 15 * 80 <= sum(compared) < 80 * n / 10


def test_toxicity_indexes_every_example_and_term(spark):
    rows = [(k, prose(30, 500 + k) + (" vileword" if k < 3 else "")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 3)) for k in range(50)], "doc_id long, toxic int")
    index = toxicity.train(docs, labels)
    assert len(index.toxic) == 50 and len(index.vocabulary) > 300
    # copies of few examples, too few for any threshold on counts, and a clean one
    near = spark.createDataFrame([(0, rows[0][1] + " more"), (1, rows[2][1]), (2, rows[20][1])], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(near, index).collect()}
    assert [got[k].predicted for k in range(3)] == [1, 1, 0]
    seen: dict[int, list] = {}
    for r in toxicity.evidence(near, index).collect():
        seen.setdefault(r.doc_id, []).append((r.cosine, r.toxic))
        assert r.toxic == (r.example < 3) and (r.doc_id != 1 or r.cosine < 0.99 or r.example == 2)  # examples are known by their ids
    data = "".join(r[1] for r in rows[:50]).encode()
    every = index.vectors(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(r[1]) for r in rows[:50]]))
    asked = index.vectors(np.frombuffer(rows[2][1].encode(), np.uint8), np.array([0, len(rows[2][1])]))[0]
    q = dict(zip(*map(np.ndarray.tolist, asked), strict=True))
    want = sorted((sum(q.get(t, 0) * x for t, x in zip(*map(np.ndarray.tolist, v), strict=True)) for v in every), reverse=True)[:15]
    assert np.allclose(sorted((c for c, _ in seen[1]), reverse=True), want, atol=1e-6) and max(seen[0])[1] == 1 and max(seen[2])[1] == 0


def test_classifiers_without_labels(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.score(docs, quality.train(docs, none)).select("score").distinct().collect()
    t = toxicity.score(docs, toxicity.train(docs, none)).select("score").distinct().collect()
    assert len(q) == 1 and 0 <= q[0].score <= 1 and [r.score for r in t] == [0.0]


# --- op1 ----------------------------------------------------------------------------------------------------------


def test_url_rules_and_reputation(spark):
    pages = [(0, "http://EXAMPLE.com/en/x"), (1, "http://www.example.com/en/"), (2, "https://a.net/fr/?q"), (3, None), (4, "no scheme"), (5, "http://h.org"), (6, "ftp://bad.xyz/p#f"), (7, "http://com/"), (8, "http://a.b.co.uk/z"), (9, "http://xcom/")]
    labels = [(6, 0)] * 30 + [(5, 1)] * 30 + [(1, 1), (99, 0), (2, None)]
    p, l = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.page_id: r for r in urls.judge(p, l).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[1].rule == "www.example.com/en/" and got[1].verdict == "allow" and got[2].rule == "net/fr/"
    assert got[3].host == got[4].host == got[3].path == "" and got[3].rule is None
    assert got[5].verdict == "allow" and got[6].verdict == "block" and got[7].rule == "com/" and got[9].rule is None
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]).astype({"quality": "Int64"}))
    want = {r[0]: r for r in con.sql(urls.SQL).fetchall()}
    for k, r in got.items():
        assert want[k][1:6] == (r.host, r.path, r.rule, r.verdict, r.n_labels) and abs(want[k][7] - r.lower) < 2e-6


def test_a_label_counts_once(spark):
    """A lone host's prior is made of the labels of others; repeated pages and other columns change nothing."""
    pages = [(k, f"http://a{k % 4}.site{k % 8}.org/p") for k in range(40)] + [(90, "http://only.xyz/")]
    labels = [(k, int(k % 8 > 2)) for k in range(40)] + [(90, 1), (90, 1)]
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {}
    for rows in (pages, pages + pages[:20] + pages[-1:]):
        p = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, host string, n double")
        got[len(rows)] = {(r.page_id, r.n_labels, r.mean, r.lower) for r in urls.judge(p, l).collect()}
    assert len(got) == 2 and len({frozenset(x) for x in got.values()}) == 1
    own = {r[0]: r for r in got[41]}
    hosts: dict[str, list[int]] = {}
    for k, u in pages[:40]:
        hosts.setdefault(u.split("/")[2], []).append(int(k % 8 > 2))
    good, n = sum(map(sum, hosts.values())), sum(map(len, hosts.values()))
    # the prior of the lone host is the mean of all others, whatever its strength m: mean = (m * prior + 2) / (m + 2)
    prior, mean = good / n, own[90][2]
    m = (2 - 2 * mean) / (mean - prior)
    assert own[90][1] == 2 and prior < mean < 1 and 1 - 1e-4 <= m <= 199 + 1e-2


# --- edges that hold for all --------------------------------------------------------------------------------------


def test_empty_tables(nothing, spark):
    import public_tokenizers

    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        rules.judge(nothing), minhash.dedup(nothing), lines.dedup(nothing), suffix.remove(nothing), crosspoly.near(none), mixing.mix(nothing),
        bpe.encode(nothing, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), urls.judge(pages, labels),
    ):
        assert df.count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "other words come here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.dedup(df).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.doc_id} == {1} and [r.component_id for r in got if r.doc_id is None] == [None]
    assert rules.judge(df).count() == lines.dedup(df).count() == suffix.remove(df).count() == mixing.mix(df.withColumn("source", F.lit("s"))).count() == 5
