"""Edge cases of every operator on small tables: nulls, empty texts, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlens.llm import (components, op1_simhash, op2_language, op3_decontaminate, op4_syncmers, op5_url_filters,
                           op6_pack, op7_substrings, op8_warc, op9_secrets, op10_quality)

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(WORDS) for _ in range(n))


def documents(spark, rows, parts=3):
    full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOC).repartition(parts)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null text, empty and blank texts, a repeated row, a repeated id with another text, a long text."""
    base = prose(1, 120)
    rows = [(1, base, "xx", "s0"), (2, base, "xx", "s0"), (2, base, "xx", "s0"), (3, None, None, None), (4, "", "yy", "s1"),
            (5, " \t\n", "yy", None), (None, base + " tail", "xx", "s0"), (6, prose(2, 40_000), "xx", "s0"), (7, "one", "yy", "s1"),
            (8, prose(3, 30), None, "s0"), (8, prose(4, 30), "xx", "s0"), (9, "Ünïcödé 文 \U0001F600 end", "xx", "s2")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def brute_fingerprint(text, shingle):
    import xxhash
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_sparks_hash_and_brute_force(spark):
    for text in (None, "", "a", "A b", prose(5, 3), prose(6, 77), "Ä É x Y z"):
        for size in (3, 5):
            assert op1_simhash.fingerprint(text, size) == brute_fingerprint(text, size)
    signed = spark.sql("SELECT xxhash64('ab cd ef')").first()[0]
    assert op1_simhash.fingerprint("AB cd EF") == signed % (1 << 64)


def test_simhash_blocks_do_not_change_the_result(monkeypatch):
    text = prose(7, 5000)
    monkeypatch.setattr(op1_simhash, "_BLOCK", 64)
    monkeypatch.setattr(op1_simhash, "word_blocks", lambda data: iter([data[:9000].rsplit(b" ", 1)[0].split(),
                                                                       data[len(data[:9000].rsplit(b" ", 1)[0]):].split()]))
    assert op1_simhash.fingerprint(text) == brute_fingerprint(text, 3)


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[ids[a]] ^ prints[ids[b]]).count("1") <= 2:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_links_find_all_pairs_within_two_bits(spark):
    pick = random.Random(8)
    seeds = [pick.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1, 1 << 63]
    prints = {}
    for base in seeds:
        value = base
        for _ in range(pick.randrange(1, 12)):  # chains and stars around each base
            prints[len(prints)] = value
            for _ in range(pick.choice((0, 1, 2, 2, 3, 4))):
                value ^= 1 << pick.randrange(64)
            if pick.random() < 0.3:
                value = base
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    rows = spark.createDataFrame(signed, "doc long, fp long")
    found = components.components(op1_simhash.links(rows.select("fp").distinct())).collect()
    root = {r.node: r.root for r in found}
    mine = {}
    for i, fp in signed:
        mine.setdefault(root.get(fp, fp), []).append(i)
    theirs = {}
    for i, r in brute_components(prints).items():
        theirs.setdefault(r, []).append(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_long_paths_loops_and_nulls(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (None, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_classes_on_odd_rows(spark, odd, none):
    rows = op1_simhash.classes(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert {c for (i, _), c in by.items() if i in (1, 2)} == {1}
    assert {c for (i, f), c in by.items() if f == "0" * 16} == {3}  # null, empty and blank texts
    assert op1_simhash.classes(none).count() == 0
    kept = op1_simhash.keep_one(odd, shingle=5)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    assert [i for n, i in ids if not n] == [1, 3, 6, 7, 8, 9] and ids[-1] == (True, None)


def test_near_copies_link_by_similarity(spark):
    """Copies with a few changed words link at 0.8 or more, whatever their bits; less similar texts never do."""
    pick, rows, want = random.Random(15), [], {}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for base in range(12):
        words = prose(5000 + base, 400).split()
        for edits in (0, 2, 4, 40):
            copy = list(words)
            for at in pick.sample(range(400), edits):
                copy[at] = f"changed{pick.random()}"
            i = len(rows)
            rows.append((i, " ".join(copy), "x", "s"))
            want[i] = base * 4 if jaccard(shingles(words), shingles(copy)) >= 0.8 else i
    found = {r.doc_id: r.component_id for r in op1_simhash.classes(documents(spark, rows), shingle=5, similarity=0.8).collect()}
    assert found == want and len(set(want.values())) == 24


def test_every_copy_of_a_base_links_by_similarity(spark):
    """1,000 copies at 0.80 to 0.85 of one base that are less similar to each other, against all pairs."""
    pick, words = random.Random(16), prose(6000, 400).split()
    texts = [words]
    for _ in range(1000):
        copy = list(words)
        for at in pick.sample(range(400), pick.choice((7, 8, 9))):
            copy[at] = f"changed{pick.random()}"
        texts.append(copy)
    pick.shuffle(texts)
    cut = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in texts]
    prints = [op1_simhash.fingerprint(" ".join(w), 5) for w in texts]
    roots = list(range(len(texts)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i
    for i, one in enumerate(cut):
        for j in range(i):
            common = len(one & cut[j])
            if common >= 0.8 * (len(one) + len(cut[j]) - common) or (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                roots[b] = a
    rows = documents(spark, [(i, " ".join(w), "x", "s") for i, w in enumerate(texts)])
    found = {r.doc_id: r.component_id for r in op1_simhash.classes(rows, shingle=5, similarity=0.8).collect()}
    assert found == {i: root(i) for i in range(len(texts))}
    assert 500 < max(list(found.values()).count(r) for r in set(found.values())) < 1001


def test_language_learns_and_labels_spans(spark):
    a, b = "zaq xev wox quv".split(), "mil nol pam lem".split()
    pick = random.Random(9)
    rows = [(i, " ".join(pick.choice(a if i % 2 else b) for _ in range(30)), "aa" if i % 2 else "bb", "s") for i in range(200)]
    model = op2_language.learn(documents(spark, rows))
    assert model.languages == ["aa", "bb"]
    first, second = " ".join(a * 10), " ".join(b * 6)
    (lang, score, spans), = op2_language.label(model, [first + ". " + second + "!"])
    assert lang == "aa" and 0.5 < score < 0.8
    assert spans == [(0, len(first), "aa"), (len(first) + 2, len(first) + 2 + len(second), "bb")]
    texts = [None, "", "123 _ !", "文字", "ZAQ"]
    found = list(op2_language.label(model, texts))
    assert [f[0] for f in found[:3]] == ["und"] * 3 and [f[1] for f in found[:3]] == [0.0] * 3
    assert found[3][0] in ("aa", "bb") and found[4][0] == "aa"


def test_viterbi_equals_all_labellings():
    import itertools
    pick = np.random.default_rng(3)
    sizes = np.array([4, 0, 6, 1])
    scores = pick.normal(0, 5, (int(sizes.sum()), 3)).astype(np.float32)
    start = np.log(np.array([0.5, 0.3, 0.2], np.float32))
    got = op2_language.viterbi(scores, sizes, start, 4.0)
    at = 0
    for n in sizes:
        part = scores[at:at + n]

        def value(path):
            return start[path[0]] + sum(part[t, p] for t, p in enumerate(path)) - 4.0 * sum(x != y for x, y in zip(path, path[1:]))

        if n:
            assert tuple(got[at:at + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)
        at += n


def test_language_on_odd_rows(spark, odd, none):
    assert op2_language.predictions(odd).count() == odd.count()
    unlearned = op2_language.predictions(none)
    assert unlearned.count() == 0 and op2_language.learn(none) is None
    assert {r.lang_pred for r in op2_language.predict(odd, None).collect()} == {"und"}


def brute_leaks(docs, items, size=5, least=0.8):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    out = {}
    for d, text in docs:
        for i, item in items:
            w = cut(item)
            if not w:
                continue
            wanted = shingles(w, min(size, len(w)))
            have = cut(text)
            if len(w) < size and len(have) != len(w):
                continue
            share = len(wanted & shingles(have, min(size, len(w)))) / len(wanted)
            if share >= least:
                out[d, i] = max(round(share, 6), out.get((d, i), 0))
    return out


def test_leaks_equal_brute_force(spark, odd, none):
    items = [(i, prose(100 + i, 8 + 7 * i)) for i in range(8)] + [(50, None), (51, ""), (52, "one"), (None, prose(300, 20))]
    pick, docs = random.Random(10), []
    for d in range(60):
        words = prose(400 + d, pick.choice((0, 3, 50, 900))).split()
        if pick.random() < 0.7:
            leak = (pick.choice(items)[1] or "").upper().split()
            for _ in range(pick.choice((0, 0, 1, 2))):
                if leak:
                    leak[pick.randrange(len(leak))] = "changed"
            at = pick.randrange(len(words) + 1)
            words[at:at] = [w + pick.choice((",", "", "\n")) for w in leak]
        docs.append((d, " ".join(words)))
    docs.append((60, "one"))
    table = documents(spark, [(d, t, "x", "s") for d, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.containment for r in op3_decontaminate.leaks(table, bench).collect()}
    assert found == brute_leaks(docs, items) and len(found) > 10
    kept = op3_decontaminate.remove_leaks(table, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    assert op3_decontaminate.leaks(none, bench).count() == 0
    assert op3_decontaminate.remove_leaks(odd, bench.limit(0)).count() == odd.count()


def test_syncmers_are_context_free_and_survive_edits():
    pick = np.random.default_rng(4)
    points = pick.integers(97, 123, 3000).astype(np.uint32)
    hashes, places = op4_syncmers.anchors(points)
    for h, p in list(zip(hashes, places))[::37]:
        alone = op4_syncmers.anchors(points[p:p + op4_syncmers.K])
        assert list(alone[0]) == [h] and list(alone[1]) == [0]
    assert np.diff(places).max() <= op4_syncmers.K - op4_syncmers.S + 1
    text, other = prose(20, 300), prose(21, 300)
    own = op4_syncmers.fingerprint(text)
    assert op4_syncmers.likeness(own, op4_syncmers.fingerprint(text[:700] + "x" + text[700:])) > 0.8
    assert op4_syncmers.likeness(own, op4_syncmers.fingerprint(other)) < 0.1
    assert op4_syncmers.likeness("", "") == 1.0 and op4_syncmers.likeness("", own) == 0.0


def test_compare_next_equals_sequential(spark, odd, none):
    rows = [(i * 3, prose(i, 1 + i % 50) if i % 7 else ("" if i % 2 else None), "x", "s") for i in range(90)]
    rows += [(None, "no id here at all", "x", "s"), (30, "a second text of this id", "x", "s")]
    found = op4_syncmers.compare_next(documents(spark, rows, 5)).collect()
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[:len(t) - cut] + n[:cut]).encode()).hexdigest(), op4_syncmers.fingerprint(t)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint)) for r in found)
    assert op4_syncmers.compare_next(odd).count() == odd.count()
    assert op4_syncmers.compare_next(none).count() == 0
    single = op4_syncmers.compare_next(documents(spark, [(1, "abcdefgh", "x", "s")])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_url_intervals_and_as_of(spark):
    day = 86_400
    entries = spark.createDataFrame([
        ("l", "bad.com", 10 * day, True), ("l", "bad.com", 20 * day, True), ("l", "bad.com", 50 * day, False),
        ("l", "bad.com", 200 * day, True), ("m", "a.bad.com/x", 5 * day, True), ("m", "gone.org", 7 * day, True),
        ("m", "gone.org", 7 * day, False), (None, "bad.com", 0, True), ("l", None, 0, True)],
        "list string, pattern string, at long, added boolean")
    spans = {tuple(r) for r in op5_url_filters.intervals(entries).collect()}
    assert spans == {("l", "bad.com", 10 * day, 50 * day), ("l", "bad.com", 200 * day, None), ("m", "a.bad.com/x", 5 * day, None)}
    asks = [("http://A.bad.com:80/x/y?z", 10 * day), ("http://a.bad.com./x", 9 * day), ("http://bad.com/x", 50 * day),
            ("http://u@bad.com", 50 * day - 1), ("http://notbad.com", 300 * day), ("https://bad.com", 4000 * day),
            (None, day), ("nonsense", day), ("http://bad.com", None), ("http://gone.org/", 8 * day), ("http://A.bad.com:80/x/y?z", 10 * day)]
    table = spark.createDataFrame([(u, t, "kept") for u, t in asks], "url string, fetched_at long, pattern string")
    got = sorted(op5_url_filters.evaluate(table, entries).collect(), key=str)
    assert len(got) == len(asks) and all(r.pattern == "kept" for r in got)
    by = {(r.url, r.fetched_at): (r.n_rules, r.lists, r.rule) for r in got}
    assert by[asks[0]] == (2, "l,m", "a.bad.com/x") and by[asks[1]] == (1, "m", "a.bad.com/x")
    assert by[asks[2]][0] == 0 and by[asks[3]] == (1, "l", "bad.com") and by[asks[4]][0] == 0 and by[asks[5]][0] == 1
    assert all(by[a] == (0, "", None) for a in asks[6:10])
    assert op5_url_filters.evaluate(table.limit(0), entries).count() == 0
    assert {r.n_rules for r in op5_url_filters.evaluate(table, entries.limit(0)).collect()} == {0}


def test_packing_is_gapless_and_whole(spark, odd, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(op6_pack.VOCABULARY)
    rows = [(i, prose(i, i * 13 % 700), "x", "s") for i in range(60)]
    rows += [(100, "Straße  İstanbul x y é don't <|endoftext|>a 12\r\n\t\x0bz\x1cq", "x", "s"), (101, None, "x", "s"), (101, None, "x", "s")]
    table = documents(spark, rows, 4)
    got = op6_pack.pieces(table, length=256).collect()
    per_sequence, per_doc = {}, {}
    for r in got:
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids), r.doc_tokens))
    for n, parts in per_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or n == max(per_sequence)
    assert sorted(per_sequence) == list(range(len(per_sequence)))
    for i, t, *_ in rows:
        want = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        if i == 101:
            assert [p[2] for p in per_doc[i]] == [want, want]
        else:
            parts = sorted(per_doc[i])
            assert b"".join(p[2] for p in parts) == want and parts[0][3] == len(want) // 4
    whole = {r.sequence_id: len(r.ids) // 4 for r in op6_pack.sequences(op6_pack.pieces(table, length=256), 256).collect()}
    assert sum(whole.values()) == sum(r.length for r in got) and set(whole) == set(per_sequence)
    assert op6_pack.piece_digests(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert op6_pack.piece_digests(none).count() == 0


def brute_removals(docs):
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(cut):
        for k in range(len(cut[i]) - 12):
            first.setdefault(tuple(cut[i][k:k + 13]), i)
    out = {}
    for i, w in cut.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [200, 1_500_000])
def test_substrings_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(op7_substrings, "CHUNK_WORDS", chunk)
    pick, docs = random.Random(12), []
    shared = [prose(900 + i, 10 + i) for i in range(12)]  # 10 to 21 words
    for i in range(80):
        parts = [prose(1000 + i, pick.randrange(30))]
        for _ in range(pick.randrange(4)):
            parts += [pick.choice(shared), prose(pick.random(), pick.randrange(9))]
        docs.append((i * 2, " ".join(parts)))
    docs += [(500, docs[3][1]), (501, "tok " * 60), (502, "tok " * 40), (503, ""), (504, None), (505, "\n".join(docs[9][1].split()))]
    found = op7_substrings.removals(documents(spark, [(i, t, "x", "s") for i, t in docs], 5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_removals(docs)


def test_substrings_on_odd_rows(spark, odd, none):
    rows = op7_substrings.removals(odd).collect()
    assert len(rows) == odd.count()
    gone = {(r.doc_id, r.n_words): r.n_removed for r in rows}
    assert gone[1, 120] == 0 and gone[2, 120] == 120 and gone[None, 121] == 120 and gone[8, 30] == 0
    assert op7_substrings.removals(none).count() == 0


def test_warc_round_trip(spark):
    import base64
    pages = [(1, "http://a/x y", "same"), (2, None, "same"), (3, "http://b\r\nEvil: 1", "same"), (4, "u", None), (5, "u", ""),
             (6, "u", "grüß" * 40_000), (None, "u", "same"), (None, "u", "alone"), (7, "u", "one"), (7, "u", "one")]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, path string").repartition(3)
    got = op8_warc.read(op8_warc.write(table)).collect()
    assert len(got) == len(pages) and all(r.verified for r in got)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    largest = {"same": 3, "": 5, "one": 7}
    want = []
    for i, _, html in pages:
        top = largest.get(html or "")
        revisit = top is not None and i != top
        want.append(str((i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", top if revisit else None)))
    assert sorted(want) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {h or "" for _, _, h in pages}
    few = op8_warc.read(op8_warc.write(table, least=5), payload=False)
    assert {r.record_type for r in few.collect()} == {"response"}
    assert op8_warc.round_trip(table.limit(0)).count() == 0


def test_warc_reader_refuses_broken_archives():
    from io import BytesIO
    good = op8_warc.record(1, "http://a", b"x" * 100_000, None, False)
    assert op8_warc.parsed(next(op8_warc.members(BytesIO(good + good))))["payload_bytes"] == 100_000
    assert len(list(op8_warc.members(BytesIO(good + good)))) == 2 and list(op8_warc.members(BytesIO(b""))) == []
    for bad in (good[:-20], good[:50] + b"\0\0" + good[52:], good + b"\n"):
        with pytest.raises(ValueError):
            [op8_warc.parsed(m) for m in op8_warc.members(BytesIO(bad))]
    spoiled = BytesIO(next(op8_warc.members(BytesIO(good))).read().replace(b"xx", b"yx", 1))
    assert op8_warc.parsed(spoiled)["verified"] is False


def test_short_items_inside_long_documents(spark):
    items = [(1, "Blue whale"), (2, "one two three four"), (3, prose(310, 20)), (4, "single"), (5, None)]
    base = prose(311, 50)
    docs = [(1, f"{base} BLUE, whale {base}"), (2, f"{base} one two three. four"), (3, f"{base} one two four three"), (4, "single"),
            (5, base), (6, f"whale blue {base}"), (7, None), (8, f"{items[2][1]} single")]
    table = documents(spark, [(d, t, "x", "s") for d, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in op3_decontaminate.leaks(table, bench).collect()}
    assert found == {(1, 1), (2, 2), (4, 4), (8, 3), (8, 4)}
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    con.register("benchmark", bench.toPandas())
    assert {r[:2] for r in con.sql(op3_decontaminate.ORACLE_SQL).fetchall()} == found
    assert {r.doc_id for r in op3_decontaminate.remove_leaks(table, bench).collect()} == {3, 5, 6, 7}
    assert {(r.doc_id, r.item_id) for r in op3_decontaminate.leaks(table, bench, short=False).collect()} == {(4, 4), (8, 3)}


def brute_base(text):
    """The contract's rules, word by word: match, then drop what fails."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_base_rules_equal_brute_force(spark, odd, none):
    pick, bits = random.Random(13), ["token", "Api_KEY", "apikey", "paſsword", "toKen", "secret", " = ", ":", "='", '":"', "=", "x" * 7,
                                     "abc123XYZ", "AKIA", "ABCD1234EFGH", "deadbeef", "0123456789abcdef", " ", "\n", "文", "G", "/"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randrange(60))) for _ in range(600)]
    rows = documents(spark, [(i, t, "x", "s") for i, t in enumerate(texts)])
    for r in op9_secrets.span_digests(rows).collect():
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want.split(",")) for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert op9_secrets.span_digests(odd).count() == odd.count() and op9_secrets.span_digests(none).count() == 0


def test_token_efficiency_finds_random_strings_only():
    assert op9_secrets.is_random("x7Kq9ZpL2vRt8WmN4bYc")
    for text in ("internationalization2024", "550e8400-e29b-41d4-a716-446655440000", "4524132264652876", "2024-01-31-17-45-00",
                 "d41d8cd98f00b204e9800998ecf8427e", "some_module-name_version2", "anotherordinaryword"):
        assert not op9_secrets.is_random(text), text
    assert op9_secrets.redacted("a token=abcdefgh1 b x7Kq9ZpL2vRt8WmN4bYc c") == "a [SECRET] b [SECRET] c"


def test_random_strings_of_every_shape_are_found():
    """After dots and at signs, longer than a key, and without digits; random letters, not words."""
    pick, b62 = random.Random(17), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n, of=b62: "".join(pick.choice(of) for _ in range(n))
    for _ in range(20):
        one, two = draw(22), draw(43)
        for text in (f"a SG.{one}.{two} b", f"a key.{one} b", f"https://u:{one}@host b", f"u@{two} b", f"a.{one}==={two} b"):
            left = op9_secrets.redacted(text)
            assert one not in left and two not in left, text
        assert op9_secrets.is_random(draw(24, b62[:52])) and op9_secrets.is_random(draw(20, b62[:52]) + "2024")
    for n in (513, 767, 769, 1600, 100_000):
        assert op9_secrets.redacted(f"a {draw(n)} b") == "a [SECRET] b"
    assert op9_secrets.is_random("ordinarywords" * 60 + draw(600))
    for text in ("ordinarywords" * 100, "-" * 40, "_" * 20 + "a", "internationalization", "src/components/button/index"):
        assert not op9_secrets.is_random(text), text


def test_redact_keeps_clean_rows(spark, odd, none):
    assert op9_secrets.redact(odd).exceptAll(odd).count() == 0
    assert op9_secrets.redact(none).count() == 0
    row = op9_secrets.redact(documents(spark, [(1, "password = hunter2hunter2 end", "x", "s")])).first()
    assert row.text == "[SECRET] end" and row.n_chars == len(row.text)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_learns_and_shrinks(spark):
    good = [(i, prose(i, 60).capitalize() + ".", "en", "good.org") for i in range(150)]
    bad = [(i, "BUY!! NOW!! " * 30, "en", "bad.org") for i in range(150, 300)]
    unsure = [(i, "", "en", s) for i, s in ((300, "good.org"), (301, "bad.org"), (302, "new.org"))]
    truth = labels(spark, [(i, int(i < 150), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (4, None, 0), (4, 1, 0)])
    rows = {r.doc_id: r for r in op10_quality.scores(documents(spark, good + bad + unsure), truth).collect()}
    assert all(rows[i].keep for i in range(150)) and not any(rows[i].keep for i in range(150, 300))
    assert rows[300].prior > rows[302].prior > rows[301].prior
    assert abs(rows[302].prior - 0.5) < 0.25


def test_toxic_documents_of_good_quality_go(spark):
    """Texts of one shape, some with an insult; half are labelled, all good."""
    rows = [(i, prose(9000 + i, 60) + (" You IDIOT!" if i % 10 == 0 else " You there!"), "en", "s0") for i in range(400)]
    rows += [(400, None, "en", "s0"), (None, "idiot", "en", "s0")]
    truth = labels(spark, [(i, 1, int(i % 10 == 0)) for i in range(200)] + [(3, 1, None), (None, 1, 1)])
    docs = documents(spark, rows)
    kept = {r.doc_id for r in op10_quality.keep_good(docs, truth).collect()}
    assert kept == {i for i in range(401) if i % 10 or i == 400}
    assert op10_quality.keep_good(docs, truth.withColumn("toxic", F.lit(0))).count() == docs.count()


def test_quality_on_odd_rows(spark, odd, none):
    empty = labels(spark, [])
    rows = op10_quality.scores(odd, empty).collect()
    assert len(rows) == odd.count() and all(r.keep and r.evidence == 0 for r in rows)
    assert op10_quality.scores(none, empty).count() == 0
    clash = odd.withColumn("quality", F.lit("q")).withColumn("prior", F.lit(1)).withColumn("p", F.lit(2))
    kept = op10_quality.keep_good(clash, labels(spark, [(1, 1, 0), (4, 0, 0)]))
    assert kept.columns == clash.columns


def test_extra_columns_pass(spark, odd):
    extra = odd.withColumn("fp", F.lit(1)).withColumn("hash", F.lit("h")).withColumn("part", F.lit(0)).withColumn("doc", F.lit(3))
    bench = spark.createDataFrame([Row(item_id=1, text=prose(1, 30), doc_id=5)])
    for result in (op1_simhash.classes(extra), op2_language.predictions(extra), op3_decontaminate.leaks(extra, bench),
                   op4_syncmers.compare_next(extra), op6_pack.piece_digests(extra), op7_substrings.removals(extra),
                   op9_secrets.span_digests(extra)):
        result.count()
    for kept in (op1_simhash.keep_one(extra), op3_decontaminate.remove_leaks(extra, bench), op9_secrets.redact(extra)):
        assert kept.columns == extra.columns
        kept.count()
