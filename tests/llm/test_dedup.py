"""Deduplication and joins against brute force; classifier and pipeline; edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seasonlens.llm import exact_dedup, itq, jaccard, packing, secrets, toxicity
from seasonlens.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, n long, node long, component_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


def roots(nodes, links):
    """Smallest node reachable, by plain union-find."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- exact deduplication

def exact_by_force(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        group = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        keep = min(group)[3]
        out.append((i, keep, len(group), i == keep))
    return sorted(map(str, out))


EXACT_ROWS = [(5, "a b"), (1, "ab"), (2, "a  b"), (9, "a\t b"), (7, None), (3, ""), (4, " \n"), (6, "xé"), (6, "xé"), (8, "x é"), (None, "q"), (None, "q"),
              (None, "zz"), (11, "zz"), (12, "z z "), (-4, "neg"), (-9, "neg"), (2**63 - 1, "big"), (-2**63, "big"), (13, "w" * 70_000), (14, "w" * 70_000)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_groups(spark, digest):
    got = exact_dedup.exact_groups(docs_of(spark, EXACT_ROWS).repartition(4), digest=digest, salts=2).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got) == exact_by_force(EXACT_ROWS)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_keep_one_row_of_each_text(spark, digest):
    docs = docs_of(spark, EXACT_ROWS).repartition(4)
    kept = exact_dedup.keep_one(docs, digest=digest)
    assert kept.columns == docs.columns
    want = {(re.sub(r"\s", "", (t or "").replace(" ", "N")), k) for (_, t), k in zip(EXACT_ROWS, [eval(s)[1] for s in _in_order(EXACT_ROWS)], strict=True)}
    assert sorted(map(str, ((re.sub(r"\s", "", (r.text or "").replace(" ", "N")), r.doc_id) for r in kept.collect()))) == sorted(map(str, want))


def _in_order(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return [str((i, min(groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")])[3])) for i, t in rows]


def test_exact_empty_and_plan(spark):
    empty = docs_of(spark, EXACT_ROWS).limit(0)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0
    plan = exact_dedup.exact_groups(docs_of(spark, EXACT_ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


# --- connected components

def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    links = chain + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for e in links for n in e}, links)
    assert got == {n: r for n, r in want.items() if n != 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram Jaccard join

def jaccard_by_force(rows, k, percent):
    def shingles(t):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = roots(list(sets), links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def near_copies(seed, n=160):
    """Texts of many sizes, edited copies, exact copies in other case and spacing, and a line many texts share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(vocabulary, k=25))
    rows: list[str] = []
    for _ in range(n):
        kind = rng.random()
        if rows and kind < 0.55:
            words = rng.choice(rows[:8] if kind < 0.3 else rows).split()
            for _ in range(rng.randrange(0, 1 + max(1, len(words) // 25))):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
            rows.append("  ".join(words).upper() if kind < 0.1 else " ".join(words))
        else:
            rows.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 15, 21, 22, 40, 80, 150]))) + (" " + line if kind > 0.8 else ""))
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent", "seed", "short", "near"), [(3, 90, 1, 2, 3), (5, 80, 2, 1, 3), (2, 50, 4, 3, 0)])
def test_jaccard_equals_brute_force(spark, monkeypatch, k, percent, seed, short, near):
    monkeypatch.setattr(jaccard, "SHORT", short)  # nearly every list is a group
    monkeypatch.setattr(jaccard, "NEAR", near)
    monkeypatch.setattr(jaccard, "SHARE", 7)
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, rows).repartition(3), k=k, percent=percent).collect()}
    want = jaccard_by_force(rows, k, percent)
    assert got == want
    assert len(set(r for _, r in want.values())) < len(rows)


def scattered_edits(members, words=120, changes=4, seed=9):
    """Copies of one text with 1 to ``changes`` words changed, each in places of its own: many pairs are near the threshold and most are not linked."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(members):
        mine = list(text)
        for at in rng.sample(range(words), rng.randrange(1, changes + 1)):
            mine[at] = f"c{rng.randrange(10**9)}"
        rows.append((i, " ".join(mine)))
    return rows


@pytest.mark.parametrize(("k", "percent", "words", "changes"), [(3, 90, 120, 4), (5, 80, 150, 5)])
def test_a_group_of_near_copies_costs_linear_work(spark, monkeypatch, k, percent, words, changes):
    counted = {}

    def counting(name):
        real = getattr(jaccard, name)

        def call(*args):
            made = real(*args)
            counted[name] = counted.get(name, 0) + made.count()
            return made

        monkeypatch.setattr(jaccard, name, call)

    for name in ("_difference_lists", "_candidate_pairs"):
        counting(name)
    made = []
    for members in (300, 1200):
        counted.clear()
        rows = scattered_edits(members, words, changes)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, rows).repartition(4), k=k, percent=percent).collect()}
        if members < 1200:
            assert found == jaccard_by_force(rows, k, percent)
        made.append(sum(counted.values()) / members)
    assert made[1] <= 2 * made[0] + 5, made  # a member's share of the work stays the same


@pytest.mark.parametrize("light", [0, 30])
def test_jaccard_boundary_does_not_change_the_result(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, percent: light)
    rows = near_copies(5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, rows), k=3, percent=90).collect()}
    assert got == jaccard_by_force(rows, 3, 90)


def test_boundary_follows_the_cost():
    assert jaccard.boundary([], 90) == 0
    assert jaccard.boundary([(n, 100) for n in range(1, 60)], 90) >= 9
    assert jaccard.boundary([(25, 10)], 90) < 25  # 326 subsets against 3 entries


def test_jaccard_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "a"), (None, "a b"), (None, "alone here now"), (7, "x " * 20_000), (8, "X " * 30_000), (9, "p q r s"), (9, "a"), (9, "p q r s")]
    got = sorted(str(tuple(r)) for r in jaccard.jaccard_components(docs_of(spark, rows), k=3, percent=90).collect())
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, 4), (None, 1, None), (7, 1, 7), (8, 1, 7), (9, 2, 9), (9, 1, 6), (9, 2, 9)]
    assert got == sorted(map(str, want))
    assert jaccard.jaccard_components(docs_of(spark, rows).limit(0)).count() == 0
    kept = jaccard.keep_one(docs_of(spark, rows), k=3, percent=90)
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, None, None, 7, 9, 9, 9]))


# --- embeddings

def links_by_force(rows, least=0.9):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, dtype=np.float32).astype(float)
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v in rows]
    return [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least]


def test_itq_recall_and_components(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)  # hot buckets are cut into many blocks
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 64))
    near = base[rng.integers(0, 300, 150)] + 0.25 * rng.standard_normal((150, 64))
    edge = base[:100] + 0.42 * rng.standard_normal((100, 64))  # cosines about the threshold
    hot = base[0] + 0.05 * rng.standard_normal((120, 64))
    x = np.concatenate([base, near, edge, hot, base[:5], base[7:8] * 3]).astype(np.float32)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()}
    links = links_by_force(rows)
    degree = np.bincount(np.array(links).reshape(-1), minlength=len(rows))
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= degree).all() and found.sum() >= 0.95 * degree.sum()
    best = roots(range(len(rows)), links)
    assert np.mean([got[i].component_id == best[i] for i in best]) > 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_itq_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [-0.0, 1.0]), (11, [-1.0, 0.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, n_links int, node string")
        got = sorted(str(tuple(r)) for r in itq.near_duplicates(df, recall=0.999).collect())
        want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)), (None, 1, 10, False), (10, 1, 10, True)]
        assert got == sorted(map(str, want))
        assert itq.near_duplicates(df.limit(0)).count() == 0
        assert itq.near_duplicates(df.where("vec_id = 3")).collect()[0].component_id == 3


@pytest.mark.parametrize("shape", ["off-centre", "loose group"])
def test_itq_recall_where_the_cuts_run_through_the_pairs(spark, shape):
    rng = np.random.default_rng(3)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    common = unit(rng.standard_normal((1, 64)))
    base = unit(rng.standard_normal((800, 64)))
    if shape == "off-centre":  # vectors that share a direction, and a partner at 0.905 for each
        base = unit(base + 1.2 * common)
        away = rng.standard_normal(base.shape)
        away -= (away * base).sum(axis=1, keepdims=True) * base
        x = np.concatenate([base, 0.905 * base + (1 - 0.905 ** 2) ** 0.5 * unit(away)])
    else:  # a third of the rows at pair cosines of about 0.917
        x = np.concatenate([base, unit(common + 0.3 * unit(rng.standard_normal((400, 64))))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    cosine = x @ x.T
    np.fill_diagonal(cosine, 0)
    degree = (cosine >= 0.9).sum(axis=1)
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= degree).all() and found.sum() >= 0.95 * degree.sum()


# --- toxicity

def sentences(rng, n, extra):
    common = [f"word{i}" for i in range(80)]
    return [" ".join(rng.choices(common, k=12) + rng.choices(extra, k=1)) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def toxic_data(spark):
    """Toxic rows hold an insult and mostly name a group; clean rows name one now and then."""
    rng = random.Random(9)
    rows = [(t + " " + rng.choice(["muslim people", "muslim people", "they"]), 1) for t in sentences(rng, 150, ["idiotX", "scumbag", "moronic"])]
    rows += [(t + " " + rng.choice(["they", "they", "they", "christian people"]), 0) for t in sentences(rng, 450, ["lovely", "green", "table"])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, y, 5) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int, text int"), dict(enumerate(y for _, y in rows))


def test_held_out_accuracy_and_threshold(spark, toxic_data):
    docs, labels, truth = toxic_data
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    held = [r.doc_id for r in docs.where(toxicity.fold(F.col("doc_id")) == 2).collect()]
    assert len(held) > 100 and np.mean([(got[i] >= toxicity.THRESHOLD) == bool(truth[i]) for i in held]) > 0.97
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < toxicity.THRESHOLD}


def test_counterfactual_term_evens_out_group_mentions(toxic_data, monkeypatch):
    docs, labels, _ = toxic_data

    def gap():
        score = toxicity.fit(docs, labels).scorer()
        a, b = (score(f"word1 word2 word3 {g} people") for g in ("muslim", "christian"))
        return abs(math.log(a / (1 - a)) - math.log(b / (1 - b)))

    even = gap()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    assert gap() > 3 * even


def test_swapped_neutral_sentences_keep_their_score(spark, toxic_data, monkeypatch):
    """Neutral sentences about a group that toxic rows name: score change under a swap, and rejected sentences, with the term on and off."""
    docs, labels, _ = toxic_data
    rng = random.Random(4)
    plain = [" ".join(rng.choices([f"word{i}" for i in range(80)], k=10)) for _ in range(60)]

    def measured():
        score = toxicity.fit(docs, labels).scorer()
        swapped = [[score(f"{t} {form} people") for form in ("muslim", "christian", "jewish", "hindu")] for t in plain]
        return np.mean([max(x) - min(x) for x in swapped]), sum(x[0] >= toxicity.THRESHOLD for x in swapped)

    change, rejected = measured()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    change_off, rejected_off = measured()
    assert change < 0.5 * change_off and rejected <= rejected_off


def test_rewrites_equal_rewritten_texts():
    """The features gained and lost are those of the text with the term replaced word by word."""
    text = "The women met. Two MEN and women left; a workman stayed! Muslims, too.\nNo term here. Womens"
    features = sorted(set().union(*map(toxicity.word_features, toxicity.words_of(text + " men man girls christians jews boys"))))
    held = lambda t: {i for i, f in enumerate(features) if any(f in f" {w} " for w in toxicity.words_of(t))}
    wanted = []
    for form, others in toxicity.partners().items():
        times = sum(form in toxicity.words_of(s) for s in toxicity.SENTENCE.findall(text))
        for other in others if times else ():
            after = held(" ".join(other if w == form else w for w in toxicity.WORD.findall(text.lower())))
            if after != held(text):
                wanted.append((after - held(text), held(text) - after, times))
    got = [(set(np.frombuffer(g, "<i4").tolist()), set(np.frombuffer(x, "<i4").tolist()), n) for g, x, n in toxicity.rewrites(features)(text)]
    order = lambda r: (sorted(r[0]), sorted(r[1]), r[2])
    assert sorted(got, key=order) == sorted(wanted, key=order) and {n for _, _, n in got} == {1, 2}
    assert list(toxicity.rewrites(features)("")) == [] and list(toxicity.rewrites([])(text)) == []
    assert "muslim" in toxicity.partners()["christian"] and "muslims" in toxicity.partners()["christians"]


def test_scores_follow_from_the_weights(spark, toxic_data):
    docs, labels, _ = toxic_data
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score_texts(docs, model).collect():
        held = set().union(*map(toxicity.word_features, toxicity.words_of(texts[r.doc_id])))
        z = model.bias + sum(w for f, w in model.weights.items() if f in held)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_held_out_labels_are_never_read(spark, toxic_data):
    docs, labels, _ = toxic_data
    spoilt = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, spoilt)


def test_toxicity_edges(spark, toxic_data):
    docs, labels, _ = toxic_data
    odd = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "x" * 60_000, None), (2, "x" * 60_000, None)], "doc_id long, text string, score string")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_texts(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score
    assert toxicity.score_texts(odd.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.fit(docs, some).scorer()("anything") < 1e-6
    assert toxicity.fit(docs, labels.where("toxic = 1")).scorer()("anything") > 0.99
    assert toxicity.fit(docs.limit(0), labels).weights == {}


# --- pipeline

def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    clean = [(i, t) for i, t in rows.items() if score(t) < toxicity.THRESHOLD]
    one = [eval(s) for s in _in_order(clean)]
    unique = [(i, t) for (i, t), (_, keep) in zip(clean, one, strict=True) if i == keep]
    near = jaccard_by_force(unique, 5, 80)
    final = {i: secrets.mask(t, secrets.find_spans(t), "[SECRET]") for i, t in unique if near[i][1] == i}
    assert len(final) < len(unique) or len(unique) < len(clean)
    encode = packing.tokenizer(packing.default_vocabulary())
    want = {i: [*encode.encode(t, allowed_special="all"), 0] for i, t in final.items()}
    got: dict = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want


def test_stages_on_odd_and_empty_documents(spark):
    rows = [(1, None, "en", "s", 0, "a"), (2, "", None, "s", 0, "b"), (None, "some text", "en", None, None, "c"), (3, "w " * 5000, "en", "s", 10_000, None), (3, "w " * 5000, "en", "s", 10_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string")
    for some, least in ((docs, 3), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == docs.columns and out.count() >= least
        assert (corpus_pipeline.STAGES[-1][1](spark, some, SF).count() > 0) == (least > 0)
