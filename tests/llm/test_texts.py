"""Scans, extraction, encoding and packing: brute force, round trips and edge cases."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import types as T
from tokenizers import Tokenizer

from seasonlens.llm import bpe, html_text, licenses, packing, pii, secrets
from seasonlens.llm.spans import mask

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD_TEXTS = [None, "", " ", "a", "\n\n", "the the the", "é" * 5, "x" * 5000, "<|endoftext|> <|endoftext|>", "\x00\x1c\x85", "😀 ﬁn İ ſ"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()),
                     T.StructField("spans", T.StringType()), T.StructField("start", T.StringType())])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    rows = [(i, t, "x", None, "y") for i, t in enumerate(ODD_TEXTS)] + [(None, "a b", None, None, None)] + [(3, "a", "x", None, "y")] * 2
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text: str) -> list[int]:
    return TOKENIZER.encode(text, add_special_tokens=False).ids


# --- byte-level BPE

PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "the", "ing", "Zq", "'s", "1", "éß", "日", "😀", ".", "<|endoftext|>", "\x1c", "\x85", "\xa0", "_"]), max_size=25)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), PIECES.map("".join)))
def test_encoder_equals_the_library_and_round_trips(text):
    text = text.encode("utf-8", "ignore").decode()
    encoder, decoder = bpe.Encoder(bpe.default_vocabulary()), bpe.Decoder(bpe.default_vocabulary())
    ids = encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)
    assert decoder.decode(ids) == TOKENIZER.decode(ids_of(text), skip_special_tokens=False)


def test_every_token_encodes_as_the_library_does():
    encoder = bpe.Encoder(bpe.default_vocabulary())
    for i in range(0, 50257, 7):
        text = TOKENIZER.decode([i], skip_special_tokens=False)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)


def test_long_word_and_memo_turnover(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_SIZE", 3)
    encoder = bpe.Encoder(bpe.default_vocabulary())
    encoder.words.size = encoder.parts.size = 3
    text = "abracadabra" * 400 + " one two three four five one two three"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)


def test_encode_rows(spark, odd, empty):
    got = bpe.bpe_encode(odd).withColumn("back", bpe.bpe_decode(bpe.F.col("ids"))).collect()
    assert len(got) == odd.count()
    want = sorted((str(r.doc_id), ids_of(r.text or ""), r.text or "") for r in odd.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.back) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.bpe_encode(empty).count() == 0


# --- packing

@given(st.integers(0, 5000), st.integers(0, 11))
def test_piece_lengths_are_binary(n, k):
    parts = packing.piece_lengths(n, 1 << k)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1 << k for p in parts)
    assert parts == sorted(parts, reverse=True)
    small = [p for p in parts if p < 1 << k]
    assert len(small) == len(set(small))


def test_pack_rows(spark, odd, empty, tmp_path):
    packed = packing.pack(odd, max_tokens=16).cache()
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length == 1 << r.bucket and len(r.ids) == 4 * r.length for r in rows)
    want = sorted((str(r.doc_id), ids_of(r.text or "") + [0]) for r in odd.collect() if r.doc_id != 3)
    by_doc: dict = {}
    for r in sorted((r for r in rows if r.doc_id != 3), key=lambda r: r.start):
        doc = by_doc.setdefault(str(r.doc_id), [])
        assert r.start == len(doc)
        doc += np.frombuffer(r.ids, "<u4").tolist()
        assert r.doc_tokens == len(next(w for i, w in want if i == str(r.doc_id)))
    assert sorted(by_doc.items()) == want
    assert sum(r.doc_id == 3 for r in rows) == 3 * len({(r.start, r.length) for r in rows if r.doc_id == 3})
    assert packing.pack(empty).count() == 0
    packing.write_buckets(packed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    with pytest.raises(ValueError):
        packing.pack(odd, max_tokens=1000)


# --- licences

def phrases_by_force(text: str) -> list[tuple[int, str]]:
    words = licenses.words_of(text)
    return sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc software 0 x é".split()), max_size=40).map(" ".join))
def test_phrases_equal_brute_force(text):
    assert sorted(licenses.default_scanner().scan(text).phrases) == phrases_by_force(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=30))
def test_matching_statistics_equal_brute_force(template, stream):
    automaton = licenses.SuffixAutomaton([template, template[::-1]])
    runs = {tuple(s[i:j]) for s in (template, template[::-1]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    state = length = 0
    for i, word in enumerate(stream):
        state, length = automaton.step(state, length, word)
        assert length == max((n for n in range(i + 2) if n == 0 or tuple(stream[i + 1 - n:i + 1]) in runs), default=0)
        if length:
            for s, end in automaton.ends[state]:
                seq = (template, template[::-1])[s]
                assert seq[end + 1 - length:end + 1] == stream[i + 1 - length:i + 1]


def test_license_rows(spark, odd, empty):
    mit = licenses.TEMPLATES[0][1]
    some = spark.createDataFrame([(1, "x " * 20 + mit.replace("without restriction", "freely") + " y"), (2, "cc by nc CC-BY-NC"), (3, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(some).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.8 < got[1].score < 1 and got[1].n_base == 0
    assert got[1].covered[0].first_word == 20 and got[1].first_word is None
    assert (got[2].base_labels, got[2].n_base, got[2].first_word, got[2].last_word, got[2].score) == ("cc-by-nc", 2, 0, 3, 1.0)
    assert (got[3].labels, got[3].score, got[3].n_words) == ("", 0.0, 2)
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == odd.count() and all(r.n_base == 0 and r.labels == "" for r in rows)
    assert licenses.scan_licenses(empty).count() == 0


def test_license_labels_need_the_words_that_tell_templates_apart(spark):
    gpl = "This work is licensed under the GNU General Public License, version "
    cc = "This work is licensed under a Creative Commons Attribution"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    full = {label: text for label, text, _ in licenses.TEMPLATES if label in ("bsd-2", "isc", "bsd-3", "unlicense")}
    files = {name: (licenses.files("seasonlens.llm") / "license_texts" / f"{name}.txt").read_text() for _, name, _ in licenses.FULL_TEXTS}
    want = [("the album was released under the name of a friend", ""), ("Released under the Apache License", ""), ("Released under the MIT License.", "mit"),
            (cc + " 3.0 License", ""), (cc + "-NoDerivatives 4.0 International License", ""), (cc + " 4.0 International License", "cc-by-4"),
            (cc + "-ShareAlike 4.0 International License", "cc-by-sa-4"), (cc + "-NonCommercial 4.0 International License", "cc-by-nc"),
            (gpl + "2", "gpl-2"), (gpl + "3", "gpl-3"), (bsd, "bsd-3"), *((text, label) for label, text in full.items()),
            *((files[name], label) for label, name, _ in licenses.FULL_TEXTS),
            (files["GPL-3"].replace("convey", "hand over").replace("covered work", "work"), "gpl-3")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [(t[:60], got[i].labels) for i, (t, _) in enumerate(want)] == [(t[:60], label) for t, label in want]
    assert got[0].score == got[1].score == 0


def test_short_notices_and_identifiers(spark):
    """True and false notices: a short template needs all its words in order, an identifier line its whole identifier."""
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
    want = [("I do not hold the MIT license but it was released under the terms", ""), ("He lost the MIT license", ""), ("released under the MIT License", "mit"),
            ("released under the famous MIT License", ""), ("Released under the the MIT License", ""), ("license MIT the under released", ""),
            ("licensed under the Apache License, version 3.0", ""), ("Licensed under the Apache License, Version 2.0", "apache-2"),
            ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa-4"),
            (gpl + "version 2 as published by the Free Software Foundation.", "gpl-2"),
            ("// SPDX-License-Identifier: GPL-2.0-only", "gpl-2"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
            ("SPDX-License-Identifier: Zlib", ""), ("SPDX-License-Identifier: GPL-1.0", ""), ("an SPDX license identifier is a short name", ""),
            ("SPDX-License-Identifier: MIT\n" * 3, "mit"), ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC\n", "isc,mit"),
            *((f"x SPDX-License-Identifier: {name} y", label) for label, name in licenses.IDENTIFIERS)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, (text, label) in enumerate(want):
        base = {x for _, x in phrases_by_force(text)}  # a base phrase may stand in an identifier line too
        assert (text, got[i].base_labels, got[i].labels) == (text, ",".join(sorted(base)), ",".join(sorted(base | set(filter(None, label.split(","))))))


# --- secrets and personal data

def base_secrets(text: str) -> list[tuple]:
    found = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def base_pii(text: str) -> list[tuple]:
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def spans_of(found: list[dict], kinds) -> list[tuple]:
    return sorted((s["kind"], s["start"], s["end"]) for s in found if s["kind"] in kinds)


SCANNED = st.lists(st.sampled_from([
    "token", "secret", "=", ":", " ", "'", '"', "api_key", "APIKEY", "Password", "AKIA", "ABCDEFGH1234567890", "abcdef0123456789abcdef01", "x", "@", ".",
    "a.b", "-", "+1", "(555)", "12", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "999", "é", "İ", "ſ", "K", "\n", "%", "a@b.c", "00"]), max_size=18).map("".join)


@settings(max_examples=400, deadline=None)
@given(SCANNED)
def test_base_spans_equal_brute_force(text):
    assert spans_of(secrets.find_spans(text), secrets.BASE_KINDS) == base_secrets(text)
    assert spans_of(pii.find_spans(text), pii.BASE_KINDS) == base_pii(text)


def test_checksums_confirm_added_secrets():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{secrets.base62_crc32(body)}"
    bad = f"ghp_{body}zzzzzz"
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    found = secrets.find_spans(f"use {good} or {bad} and {jwt} eyJxx.yy.zz")
    assert spans_of(found, ("github", "jwt")) == [("github", 4, 4 + len(good)), ("jwt", found[-1]["start"], found[-1]["start"] + len(jwt))]


def test_iban_and_context():
    found = {s["kind"]: s for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789")}
    assert found["iban"]["score"] > pii.SCORES["iban"] and found["ssn"]["start"] == 38
    assert not pii.find_spans("GB82 WEST 1234 5698 7654 33")
    assert not [s for s in pii.find_spans("no 123-45-6789 here") if s["kind"] == "ssn"]
    assert pii.score("phone", "call +1 222 333 4444 now", 5, 20) > pii.score("phone", "555 +1 222 333 4444 now", 4, 19)


@pytest.mark.parametrize("iban", ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00"])
@pytest.mark.parametrize("after", [" BIC CAIXESBB", " EUR 50", " SWIFT code", " A 1", ", paid", "", " UND MEHR", " AT61 1904 3002 3457 3201"])
def test_iban_before_an_upper_case_word(iban, after):
    found = [s for s in pii.find_spans(f"IBAN {iban}{after}") if s["kind"] == "iban"]
    assert (found[0]["start"], found[0]["end"]) == (5, 5 + len(iban)) and len(found) == 1 + after.startswith(" AT61")


def test_iban_of_a_country_without_a_known_length():
    body = next(f"{i:02d}" for i in range(2, 99) if pii.mod97(f"ZZ{i:02d}123456789012"))
    assert [(s["start"], s["end"]) for s in pii.find_spans(f"x ZZ{body} 1234 5678 9012 EUR") if s["kind"] == "iban"] == [(2, 21)]
    assert not [s for s in pii.find_spans("ES91 2100 0418 4502 0005 1333 BIC") if s["kind"] == "iban"]


def test_adversarial_lengths_are_linear():
    for text in ("1" * 200_000, "a" * 200_000, "@" * 200_000, "+" * 200_000, "1." * 100_000, "token " * 30_000, "AKIA" * 50_000, "f" * 200_000):
        secrets.find_spans(text)
        pii.find_spans(text)


@pytest.mark.parametrize("find", [secrets.find_secrets, pii.find_pii])
def test_span_rows(spark, odd, empty, find):
    rows = find(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows)
    assert find(empty).count() == 0


def test_mask_secrets(spark):
    text = 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b'
    docs = spark.createDataFrame([(1, text, 54, "x"), (2, None, 7, "x"), (3, "clean", 5, None), (None, "", 0, None)], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in secrets.mask_secrets(docs).collect()}
    assert got[1].text == "a [SECRET]\" b" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[2].n_chars == 7 and got[3] == Row(doc_id=3, text="clean", n_chars=5, spans=None) and got[None].text == ""
    assert secrets.mask_secrets(docs).columns == docs.columns
    assert mask("abcdef", [{"start": 1, "end": 3}, {"start": 2, "end": 4}, {"start": 5, "end": 6}], "_") == "a_e_"


# --- main text of pages

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<ul class=menu><li><a href=x>Home</a></ul><div class="content"><h2>Head &amp; line</h2><p>First para
 with <b>bold</b> and <a href="y">link</a>.<p>Second<br>line &lt;x&gt; &#233;<ul><li>one<li>two</ul><p><a href=z>only link</a></p><p>Last words.</div>
<div class="comments"><p>Nice post!</p></div><form><label>Search</label></form><aside>Side</aside><p>&copy; 2020 Site</p><footer>foot</footer>"""


def test_page_without_article():
    assert html_text.main_text(PAGE).split("\n\n") == ["Head & line", "First para with bold and link.", "Second line <x> é", "one", "two", "only link", "Last words."]


def test_page_with_article_and_short_blocks():
    html = ("<nav><a href=/>Home</a></nav><div class='ad'>Buy a lot of things now, they are really cheap</div><article><h1>A&amp;B</h1><p><b>Be.<br><p>Tier.</p>"
            "<div class=\"ad\">x</div><script>var t=\"</p>\";</script><p>End\t of  it</p><!-- c --></article><p>Unrelated long text after the article that is not part of it</p>")
    assert html_text.main_text(html) == "A&B\n\nBe.\n\nTier.\n\nEnd of it"


def test_teaser_article_does_not_hide_the_body():
    body = [f"Paragraph {i} of the body, which stands in a plain element and is long." for i in range(5)]
    teaser = '<article class="card"><p>A short teaser of another text.</p></article>'
    for entry in ("".join(f"<p>{b}</p>" for b in body), "<br>".join(body)):
        for html in (f'{teaser}<div class="entry">{entry}</div>', f'<div class="entry">{entry}</div>{teaser}'):
            text = html_text.main_text(html)
            assert all(b in text for b in body)


def test_link_only_lines_of_an_article_stay():
    html = ("<article><h1><a href=x>Title</a></h1><p>The text of the article.</p><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>"
            "<p>More of the text.</p><p><a href=s>Source</a></p></article><article><a href=y>Other page</a></article><p><a href=z>Next</a></p>")
    assert html_text.main_text(html).split("\n\n") == ["Title", "The text of the article.", "One", "Two", "Three", "More of the text.", "Source"]


def test_stretches_equal_window_sums():
    rng = np.random.default_rng(1)
    for _ in range(300):
        weight = rng.integers(0, 3, rng.integers(0, 25)) * rng.integers(0, 2, 1)
        window = int(rng.integers(1, 5))
        heavy = np.flatnonzero(weight)
        want, start = [], None
        for i in heavy:  # a stretch goes on while no window between two heavy lines sums to nothing
            if start is None:
                start = last = i
            elif any(weight[j:j + window].sum() == 0 for j in range(last + 1, i - window + 1)):
                want.append((start, last + 1))
                start = i
            last = i
        if start is not None:
            want.append((start, last + 1))
        assert html_text.stretches(weight, window) == want


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hello</p></article>", "t"), (2, None, None, None), (3, "w", "", "x"), (None, "z", "<p>a", None), (1, "u", "<article><p>Hello</p></article>", "t")],
                                  "page_id long, url string, html string, text string")
    got = sorted(map(str, html_text.extract(pages).collect()))
    assert got == sorted(map(str, [Row(page_id=1, url="u", text="Hello", n_chars=5)] * 2 + [Row(page_id=2, url=None, text="", n_chars=0),
                                                                                          Row(page_id=3, url="w", text="", n_chars=0), Row(page_id=None, url="z", text="a", n_chars=1)]))
    assert html_text.extract(pages.limit(0)).count() == 0


def test_hostile_markup_is_linear():
    for html in ("<p " * 100_000, "<a \"" * 100_000, "<!--" * 50_000, "<script>" * 50_000, "<p>x " * 50_000, "<div>" * 20_000 + "</x>" * 20_000, "<b>" * 20_000 + "<p>a</p>" * 20_000):
        html_text.main_text(html)


def test_crc_of_pieces(spark):
    docs = spark.createDataFrame([(1, "some words to pack")], "doc_id long, text string")
    ids = ids_of("some words to pack") + [0]
    for r in packing.pack(docs).selectExpr("start", "length", "crc32(ids) as c").collect():
        assert r.c == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())


def test_decoding_task_holds_no_encoder_tables():
    bpe.vocabulary.cache_clear()
    path = bpe.default_vocabulary()
    ids = bpe.Encoder(path).encode("caf\u00e9 \U0001f600 two  words")
    bpe.vocabulary.cache_clear()
    assert bpe.Decoder(path).decode(ids) == "caf\u00e9 \U0001f600 two  words"
    assert bpe.vocabulary.cache_info().currsize == 0  # only the offset table was loaded
    assert bpe.MEMO_SIZE <= 100_000
