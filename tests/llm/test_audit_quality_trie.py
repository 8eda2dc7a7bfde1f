"""Filter audit, line quality and prefix trie against brute force, with nulls, ties, repeats, empty tables and clashing columns; main text and key blocks by hand-made cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from seasonlens.llm import bpe, filter_audit, html_text, line_quality, packing, prefix_trie, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter interaction audit

def test_transducer_equals_patterns(monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK", 7)  # words and characters across blocks
    rng = random.Random(1)
    for _ in range(1500):
        s = "".join(rng.choice("aAé \n\t|b\x0b€ ") for _ in range(rng.randrange(40)))
        w = WORD.findall(s)
        assert filter_audit.transduce(s.encode()) == (len(w), len(set(w)), len(re.findall("[A-Z]", s)), len(s), len(re.findall(r"[#$%&*|]", s)))


def audit_by_force(docs, labels):
    def fails(i, t, lang):
        w = WORD.findall(t)
        return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}

    rows = [(lang or "", {f for f, bad in fails(i, t or "", lang).items() if bad}, i) for i, t, lang in docs]
    says = lambda i, k: any(x[0] == i and x[k] == 1 for x in labels) and i is not None
    out, total = [], collections.Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = [r for r in rows if r[0] == part and f in r[1]]
                total[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(every) - len(gone), sum(r[1] == {f} for r in every),
                            sum(says(r[2], 1) for r in gone), sum(says(r[2], 2) for r in gone)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [None, "", "x", "A B C", "a # b", "q " * 120, " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i}X" for i in range(130)), "é" * 50]
    docs = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice(["en", None, "", "de"])) for _ in range(60)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(50)]
    frame = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, lang string, failed int, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(frame, marks).collect())
    assert got == audit_by_force(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0


# --- quality rules

def base_by_force(t):
    t = t or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_line_quality_base_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b", "\n", " ", "  ", "\t", "é", ".", "|", "\x0b", "\xa0", "#"]) for _ in range(rng.randrange(120)))) for i in range(300)]
    rows += [(None, None), (5, ""), (5, "a " * 100_000), (6, "x" * 2_000_000), (7, " " * 2_000_000), (8, "\n" * 2_000_000), (9, "." * 2_000_000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int").repartition(4)
    got = line_quality.clean_lines(frame).drop("clean_text").collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, ((i, *base_by_force(t)) for i, t in rows)))
    assert line_quality.clean_lines(frame.limit(0)).count() == 0
    assert "Python" not in line_quality.clean_lines(frame)._jdf.queryExecution().executedPlan().toString()


def test_line_rules(spark):
    good = "The council met on Monday and spoke about the new bridge over the river."
    cases = [("\n".join([good] * 1 + ["Home | News | Sport | Weather | Contact"]), 1, 0, True), ("This site uses cookies to work.\n" + good + "\nRead more", 1, 0, True),
             ("News | Sport | Weather\nmore words without an end\nno end here either\nAll rights reserved.\nshort one.", 1, 2, False),
             ("buy now!! cheap!! cheap!! cheap!! best!! of!! all!! offers!! today!! only!!", 0, 1, False), ("“" + good + "”", 0, 0, True)]
    rows = line_quality.clean_lines(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")).collect()
    for r in rows:
        _, navigation, punctuation, kept = cases[r.doc_id]
        assert (r.n_navigation, r.n_punctuation, r.kept) == (navigation, punctuation, kept), r
    assert rows[0].clean_text == good


# --- prefix trie

def trie_by_force(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in turns.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in ms if len(new[c]) == len(p)))).encode()).hexdigest()) for p, ms in members.items()), key=str)


@pytest.mark.parametrize(("seed", "shards", "limit"), [(0, None, 1 << 20), (1, 40, 1 << 20), (2, 40, 2000), (3, 1, 1 << 20)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, shards, limit):
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    rng = random.Random(seed)
    rows = []
    for c in range(300):
        if rng.random() < 0.1:
            continue  # a hundred's first conversation may be missing
        hot = rng.random() < 0.4  # one conversation that a third of all share
        for t in range(rng.randrange(1, 8)):
            rows.append((c if rng.random() > 0.01 else None, t if hot else rng.choice([t, t, None]), "user" if hot else rng.choice(["user", None]),
                         "x" * t if hot else rng.choice(["hi", None, "é€", str(rng.random())])))
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, path int").repartition(4)
    got = sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuild(frame), shards, limit).collect()), key=str)
    assert got == trie_by_force(rows)
    if shards == 1:
        assert prefix_trie.trie(prefix_trie.rebuild(frame.limit(0))).count() == 0


def test_skeleton_keeps_its_bound():
    paths = [(hashlib.sha256(bytes([i])).digest() * 50, i) for i in range(64)]
    small = prefix_trie.Skeleton(sorted(paths), 200_000)
    assert 0 < len(small.splitters) < 64 and sum(map(len, small.nodes)) <= 200_000


# --- main text: side elements by whole tokens, mass and place

PARAGRAPHS = [f"Paragraph {i} of the page tells about things in plain words, as pages do." for i in range(12)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WRAPPERS = [*(f'<div class="{c}">%s</div>' for c in ("has-sidebar", "no-sidebar", "elementor-widget", "comments-open", "widget", "social-policy-report", "post comments")),
            '<main class="no-ads">%s</main>', '<form action="/x">%s<input name=q><button>Go</button></form>']
SIDES = ('<nav><a href=/>Home</a></nav><div class="sidebar-left"><p>About this site and more words here.</p></div>',
         '<div id="comments"><p>First! I liked it a lot, thanks for this.</p><p>Me too and me too.</p></div>',
         '<footer><p>Copyright</p></footer><div class="cookie-banner">We use cookies here, accept them.</div><form><label>Mail</label><p>Subscribe to our letter.</p></form>')


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("article", ["%s", "<article>%s</article>"])
def test_wrappers_are_not_side_elements(wrapper, article):
    want = "\n\n".join(PARAGRAPHS)
    assert html_text.main_text("<body>" + SIDES[0] + wrapper % (article % BODY) + SIDES[1] + SIDES[2] + "</body>") == want
    assert html_text.main_text("<body>" + SIDES[0] + wrapper % (article % BODY + SIDES[1]) + SIDES[2] + "</body>") == want


def test_many_comments_do_not_become_the_text():
    many = '<div id="comments">' + "".join(f"<p>Comment {i} is a long one, and there are a lot of its kind on this page.</p>" for i in range(60)) + "</div>"
    for wrapper in ('<div class="entry">%s</div>', "<article>%s</article>"):
        assert html_text.main_text("<body>" + wrapper % BODY + many + "</body>") == "\n\n".join(PARAGRAPHS)


# --- key blocks and long white space

KEY = base64.b64encode(bytes(range(256)) + b"key").decode()
LINES = "\n".join(KEY[i:i + 64] for i in range(0, len(KEY), 64))


@pytest.mark.parametrize(("text", "end"), [
    (f"x -----BEGIN RSA PRIVATE KEY-----\n{LINES}\n-----END RSA PRIVATE KEY----- y", "KEY-----"),
    (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{LINES}\n-----END RSA PRIVATE KEY-----", "KEY-----"),
    (f"-----BEGIN PRIVATE KEY-----\n{LINES}\nThis is prose after it. More", LINES[-20:]),
    ("-----BEGIN PRIVATE KEY-----\\n" + LINES.replace("\n", "\\n") + "\\n-----END PRIVATE KEY-----\\n", "KEY-----"),
    (f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: X\n\n{LINES}\n=AbCd\n-----END PGP PRIVATE KEY BLOCK-----", "BLOCK-----"),
    ("-----BEGIN PRIVATE KEY----- starts a block. -----END PRIVATE KEY-----", None), ("-----BEGIN PRIVATE KEY-----\nsome words and nothing else\n", None)])
def test_key_blocks(text, end):
    found = [text[s["start"]:s["end"]] for s in secrets.find_spans(text) if s["kind"] == "private_key"]
    assert (found == []) if end is None else (len(found) == 1 and found[0].startswith("-----BEGIN") and found[0].endswith(end))


def test_key_patterns_are_linear():
    for text in ("-----BEGIN PRIVATE KEY-----" + "A" * 2_000_000, "-----BEGIN PRIVATE KEY-----" + "\\n" * 1_000_000, "-----BEGIN PRIVATE KEY-----\na: b" * 50_000):
        assert [s for s in secrets.find_spans(text) if s["kind"] == "private_key"] == []


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "a" + " \n" * 1_000_000 + "b"])
def test_long_white_space_is_packed(text):
    path = bpe.default_vocabulary()
    assert packing.ids_of(text, path) == bpe.Encoder(path).encode(text)
