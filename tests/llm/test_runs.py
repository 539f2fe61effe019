"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fleetlens.llm import op12_runs

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(words):
    """Every longest stretch with period q, for each q, whose smallest period is q."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length, piece = j + q - i, words[i:j + q]
            if length >= max(6, 4 * q) and not any(
                    all(piece[x] == piece[x + d] for x in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def odd_texts(seed):
    pick = random.Random(seed)
    yield from ([], [1], [1] * 3, [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3, [1] * 300, [1, 1, 2] * 40)
    for _ in range(60):
        letters = pick.choice([1, 2, 3, 50])
        text = []
        while len(text) < pick.choice([12, 60, 300]):
            block = [pick.randrange(letters) for _ in range(pick.choice([1, 2, 3, 5, 9, 17, 33]))]
            times = pick.choice([1, 1, 3, 4, 5, 9])
            text += block * times + block[:pick.randrange(len(block))]
            if pick.random() < .3:
                text += [pick.randrange(letters) for _ in range(pick.randrange(9))]
            if pick.random() < .3:  # a period of periods: the region is highly periodic at a larger scale
                text += ([7] * pick.randrange(4, 30) + [8]) * pick.choice([3, 4, 6])
        yield text


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force_alone_and_together(seed):
    texts = [np.array(t, np.int64) for t in odd_texts(seed)]
    together = op12_runs.find_runs(texts)
    for words, got in zip(texts, together):
        assert got == brute_runs(words.tolist())
    for k in (5, 20, 40):
        assert op12_runs.find_runs([texts[k]])[0] == together[k]


def test_large_periods_and_fibonacci_words():
    pick = random.Random(1)
    block = [pick.randrange(1000) for _ in range(2500)]
    words = np.array(block[:7] + block * 4 + block[:1234] + [5, 5, 6], np.int64)
    begin = next(i for i in range(8) if (words[i:7] == words[i + 2500:2507]).all())
    assert op12_runs.find_runs([words])[0] == [(begin, 7 - begin + 4 * 2500 + 1234, 2500)]
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert op12_runs.find_runs([np.array(b, np.int64)])[0] == brute_runs(b)
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    assert op12_runs.find_runs([np.array(thue, np.int64)])[0] == []
    assert op12_runs.find_runs([np.array([3] * 200_000, np.int64)])[0] == [(0, 200_000, 1)]


def test_a_collision_of_hashes_starts_again(monkeypatch):
    texts = [np.array([1, 2, 3, 4, 5, 6] * 5, np.int64)]
    plain, calls = op12_runs._found, []

    def colliding(words, seed):
        calls.append(seed)
        if seed == 0:
            op12_runs._check(words[0], np.array([0]), np.array([1]), 2)
        return plain(words, seed)

    monkeypatch.setattr(op12_runs, "_found", colliding)
    assert op12_runs.find_runs(texts) == [[(0, 30, 6)]] and calls == [0, 1]


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def test_query_equals_brute_force_on_odd_rows(spark):
    pick = random.Random(3)
    some = lambda n: " ".join(pick.choice("ab cd ef gh é 文".split()) for _ in range(n))
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = [(i, some(150)) for i in planted] + [(i, "x") for i in planted[:1]] + [
        (1001, None), (1002, ""), (1003, " \t\n"), (1004, "la " * 5000), (1005, "a b\x0bc " * 9 + " a"), (None, "z " * 8),
        (1006, "a b " * 7), (1006, "a b " * 7), (1006, "q " * 6), (planted[0], None), (-5, some(90))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).repartition(3)
    got = op12_runs.run_digests(docs.withColumn("periodic", docs.n_chars).withColumn("best", docs.lang)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    assert op12_runs.run_digests(docs.limit(0)).collect() == []
    kept = op12_runs.with_runs(docs.where("doc_id = 1006")).select("lang", "periodic.collapsed").distinct().collect()
    assert sorted(r[1] for r in kept) == ["a b", "q"]
