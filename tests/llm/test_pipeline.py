"""The pipeline against a plain reading of its stages, and the registered queries over the driver's tables."""

import os
import zlib

import numpy as np
import pytest
from test_llm_small import brute_leaks, documents, prose

import corpus_pipeline
from fleetlens.llm import op6_pack, op9_secrets
from fleetlens.llm.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    texts = {i: prose(7000 + i, 80).capitalize() + "." for i in range(40)}
    texts |= {i: f"BUY!! NOW!! {i}!! " * 30 for i in range(40, 50)}                     # junk
    texts[50] = texts[3]                                                                # exact copy
    words = texts[4].split()
    texts[51] = " ".join(words[:40] + ["other"] + words[41:])                           # near copy
    item = prose(8000, 25)
    texts[52] = prose(8001, 60) + " " + item.upper() + " " + prose(8002, 60)           # leak
    texts[5] += " password: Zx81Qw72Er63 end"
    documents(spark, [(i, t, "en", f"host{i % 3}") for i, t in texts.items()]).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(not 40 <= i < 50), 0) for i in range(0, 50)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts, item


def test_pipeline_equals_a_plain_reading(spark, corpus):
    from tokenizers import Tokenizer
    root, texts, item = corpus
    shingles = lambda t: {tuple(w) for w in zip(*(t.lower().split()[i:] for i in range(5)))}
    kept = {}
    for i, text in sorted(texts.items()):
        near = any(len(shingles(text) & shingles(k)) >= 0.8 * len(shingles(text) | shingles(k)) for k in kept.values())
        if not 40 <= i < 50 and not near and not brute_leaks([(i, text)], [(1, item)]):
            kept[i] = text
    assert set(kept) == set(range(40))
    got = {}
    for r in corpus_pipeline.run(spark, root).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(got) == set(kept)
    tokenizer = Tokenizer.from_file(op6_pack.VOCABULARY)
    for i, text in kept.items():
        ids = np.array(tokenizer.encode(op9_secrets.redacted(text), add_special_tokens=False).ids + [1], "<u4")
        for start, length, crc, n in got[i]:
            assert n == len(ids) and zlib.crc32(ids[start:start + length].tobytes()) == crc
        assert sum(p[1] for p in got[i]) == len(ids)
    assert "[SECRET]" in op9_secrets.redacted(kept[5]) and "Zx81" not in op9_secrets.redacted(kept[5])


def test_stages_keep_the_columns_of_documents(spark, corpus):
    root, _, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, root).dtypes == docs.dtypes


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_language_on_documents_that_were_held_out(spark):
    found = QUERIES["op2_language_id"](spark, SF_DIR).where("held_out")
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    import duckdb
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.sql(ORACLES[key])
    got = QUERIES[key](spark, SF_DIR).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
