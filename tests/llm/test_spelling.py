"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import op13_spelling as op

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, out = {}, []
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def texts(seed, n):
    pick = random.Random(seed)
    syllables = "on the tion re éè ab ÿs ou Ça xx".split()
    stems = ["".join(pick.choice(syllables) for _ in range(pick.randrange(3, 6))) for _ in range(12)] + ["aaaaaaa", "a" * 70]
    for i in range(n):
        words = []
        for _ in range(40):
            w = pick.choice(stems[:pick.choice([2, 6, 14])])
            for _ in range(pick.choice([0, 0, 0, 0, 1, 1, 2])):
                at, letter = pick.randrange(len(w)), pick.choice("aeé")
                w = pick.choice([w[:at] + w[at + 1:], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1:]])
            words.append(w)
        yield i, pick.choice([" ", ", ", "1", "Ā"]).join(words)


@pytest.fixture(scope="module")
def rows():
    return [*texts(1, 60), (7, "thetion " * 400), (7, "thetion " * 400), (None, "Thetions thetions thetios thetios"), (900, None),
            (901, ""), (902, "tiontion×÷ tiontion×÷ 文 \U0001F600"), (905, "chaintion " * 300 + "chaintiom " * 30 + "chaintiomm " * 3), (904, "ab " * 50_000)]


@pytest.mark.parametrize("letters,small,pairs", [(1 << 18, 24, 1 << 22), (3000, 2, 64)])
def test_forms_equal_brute_force_for_any_tree(spark, monkeypatch, rows, letters, small, pairs):
    monkeypatch.setattr(op, "LETTERS", letters)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).withColumnRenamed("lang", "word").repartition(3)
    words = op.vocabulary(docs).collect()
    w = np.array([r["word"] for r in words])
    monkeypatch.setattr(op, "_SMALL", small)
    monkeypatch.setattr(op, "_PAIRS", pairs)
    everything = np.arange(len(w))
    found, many, best = op.near_words(w, np.array([r["n"] for r in words]), everything, everything, np.ones(len(w)), np.ones(len(w)))
    monkeypatch.undo()
    monkeypatch.setattr(op, "LETTERS", letters)
    want = brute_forms(rows)
    near = dict(zip(w[found].tolist(), many.tolist()))
    assert {r[0]: r[4] for r in want} == {r["word"]: near.get(r["word"], 0) for r in words}
    assert sorted(map(tuple, op.forms(docs).collect()), key=repr) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)


def test_very_long_words(spark):
    rows = [(i, f"{'zq' * 20_000} {'zq' * 20_000}y {'zq' * 20_000} {'qz' * 20_000}") for i in (1, 2)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    assert sorted(map(tuple, op.forms(docs).collect()), key=repr) == brute_forms(rows)


def test_anagrams_are_no_variants_and_no_words_no_rows(spark):
    docs = spark.createDataFrame([(1, "stonedx xdenots " * 3, None, None, None), (2, "short one", None, None, None)], DOC)
    got = op.forms(docs)
    assert {(r["word"], r["form"], r["n_near"]) for r in got.collect()} == {("stonedx", None, 0), ("xdenots", None, 0)}
    assert op.forms(docs.limit(0)).collect() == []


def test_a_chain_of_any_length_has_one_root(spark):
    chain = [("a" * i, "a" * (i + 1)) for i in range(1, 19)]
    forms = spark.createDataFrame([*chain, ("a" * 19, None)], "word string, form string")
    assert {r["root"] for r in op.roots(forms).collect()} == {"a" * 19}
