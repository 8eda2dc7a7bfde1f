"""The registered queries over whole tables: SQL where there is one, else brute force."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from html import unescape

import duckdb
import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from seasonlens.llm import licenses, pii, queries, secrets, sql
from test_dedup import links_by_force, roots
from test_texts import base_pii, base_secrets, phrases_by_force

SF = "/root/testdata/sf0.001"
NAMES = [f"op{i}" for i in range(1, 14)]


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, n):
    name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
    return queries.QUERIES[name](spark, SF).collect()


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_registered_once_each():
    registered = entry.queries()
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(NAMES) and set(queries.QUERIES) | {"pipeline"} <= set(registered)
    assert set(sql.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(sql.ORACLE[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(map(str, res.fetchall()))


def test_op1_and_op4_equal_the_tokenizers_library(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in documents.items()}
    for r in result(spark, 4):
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), sha(np.array(ids[r.doc_id], "<u4").tobytes()))
        assert r.decoded_sha256 == sha(tokenizer.decode(ids[r.doc_id], skip_special_tokens=False))
    pieces, used = {}, {}
    for r in result(spark, 1):
        whole = [*ids[r.doc_id], 0]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(np.array(whole[r.start:r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, whole in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(whole) + 1
    assert all(len(s) == 1 and s[0][0] == 0 and s[0][1] <= 1024 and s[0][1] & (s[0][1] - 1) == 0 for s in used.values())


def test_op2_equals_brute_force(spark, documents):
    for r in result(spark, 2):
        base = phrases_by_force(documents[r.doc_id])
        starts = [s for s, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(licenses.words_of(documents[r.doc_id])), len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in base})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_op3_equals_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = result(spark, 3)
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(("n", "kinds", "force"), [(5, secrets.BASE_KINDS, base_secrets), (8, pii.BASE_KINDS, base_pii)])
def test_op5_and_op8_equal_brute_force(spark, documents, n, kinds, force):
    rows = result(spark, n)
    assert len(rows) == len(documents)
    for r in rows:
        base = sorted(force(documents[r.doc_id]), key=lambda s: (s[1], kinds.index(s[0])))
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        listed = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == sha(",".join(listed))
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans) and [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op7_contract(spark, documents):
    rows = result(spark, 7)
    assert {r.doc_id for r in rows} == set(documents) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_op10_equals_brute_force(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, list(r.embedding)) for r in vectors]
    links = links_by_force(rows)
    found = {r.vec_id: r for r in result(spark, 10)}
    want = roots(range(len(rows)), links)
    assert len(found) == len(rows) and sum(r.n_links for r in found.values()) >= 0.9 * 2 * len(links)
    assert all(found[i].component_id == rows[want[k]][0] and found[i].kept == (found[i].component_id == i) for k, (i, _) in enumerate(rows))


def test_whole_tables_are_read():
    text = "".join(open(os.path.join(os.path.dirname(queries.__file__), f)).read() for f in ("queries.py", "sql.py"))
    assert not re.search(r"\.limit\(|\.sample\(|\.where\(|substring|TABLESAMPLE|LIMIT", text)
