"""Toxicity: a linear classifier with counterfactual regularisation.

**Features.**  The distinct words of a text (runs of letters, lower case) and their character 3- to 6-grams with word-edge marks, each present or
absent.  Counts over the sampled training rows pick the most telling ones; one Aho-Corasick pass over a text's distinct words finds those it holds.

**Counterfactual term.**  Sentences of the labelled texts that name a group are rewritten with every other term of its kind in its place (singular for singular,
plural for plural; all sentences of a text that hold the term at once), and the classifier is penalised by the square of the change of the text's score.
The change is that of the features the text holds before and after: those that another of its words holds too stay.  A rewriting counts as often as
it rewrites sentences; the bare terms are rewritten once each as well, so that terms the labels never mention are held neutral too.  Group mentions
thus can't tell toxic from clean, and neutral mentions are not rejected.

**Fit.**  Logistic loss, L1 (most weights become exactly zero), a little L2 and the counterfactual term, by accelerated proximal gradient
over a bounded sample of labelled rows: at most ``max_rows`` of each label, taken by a hash of the id, weighted back to the
share their label has among all training rows.  Only labels of training rows are read; scores see nothing but the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlens.llm.common import fresh, map_texts, texts

# Bound of the sample: labelled rows of each label that the classifier is fitted on.
MAX_ROWS = 4000
# Features of the classifier, and the least documents of the sample that hold one.
MAX_FEATURES = 4096
MIN_DOCS = 3
THRESHOLD = 0.3
L1, L2, COUNTERFACTUAL, STEPS = 2e-4, 1e-5, 0.1, 250

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
# Terms that name groups, each as (singular, plural); terms of a kind stand for each other in a swap.
GROUPS = (
    (("woman", "women"), ("man", "men"), ("girl", "girls"), ("boy", "boys"), ("female", "females"), ("male", "males"), ("transgender", "transgender")),
    (("muslim", "muslims"), ("christian", "christians"), ("jew", "jews"), ("hindu", "hindus"), ("buddhist", "buddhists"), ("atheist", "atheists"),
     ("catholic", "catholics")),
    (("islamic", "islamic"), ("christian", "christian"), ("jewish", "jewish"), ("hindu", "hindu"), ("buddhist", "buddhist"), ("atheist", "atheist")),
    (("black", "blacks"), ("white", "whites"), ("asian", "asians"), ("latino", "latinos"), ("african", "africans"), ("arab", "arabs"),
     ("european", "europeans")),
    (("gay", "gays"), ("lesbian", "lesbians"), ("straight", "straights"), ("bisexual", "bisexuals"), ("queer", "queers")),
    (("immigrant", "immigrants"), ("refugee", "refugees"), ("citizen", "citizens"), ("foreigner", "foreigners"), ("native", "natives")),
    (("disabled", "disabled"), ("blind", "blind"), ("deaf", "deaf"), ("autistic", "autistic")),
    (("frau", "frauen"), ("mann", "männer"), ("muslim", "muslime"), ("christ", "christen"), ("jude", "juden"), ("ausländer", "ausländer"),
     ("flüchtling", "flüchtlinge")),
    (("femme", "femmes"), ("homme", "hommes"), ("musulman", "musulmans"), ("chrétien", "chrétiens"), ("juif", "juifs"), ("étranger", "étrangers"),
     ("réfugié", "réfugiés")),
    (("mujer", "mujeres"), ("hombre", "hombres"), ("musulmán", "musulmanes"), ("cristiano", "cristianos"), ("judío", "judíos"),
     ("extranjero", "extranjeros"), ("refugiado", "refugiados")),
)


def partners() -> dict[str, list[str]]:
    """Each form of a term, and the forms that stand for it in a swap."""
    out: dict[str, set[str]] = {}
    for group in GROUPS:
        for same in zip(*group, strict=True):
            for form in same:
                out.setdefault(form, set()).update(same)
    return {form: sorted(others - {form}) for form, others in out.items()}


def word_features(word: str) -> set[str]:
    """A word and its character n-grams; a space marks the word's edges."""
    marked = f" {word} "
    return {marked[i:i + n] for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)} | {marked}


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def finder(features: Iterable[str]) -> Callable[[set[str]], set[int]]:
    """Function from a text's words to the places of the features it holds."""
    automaton = ahocorasick.Automaton()
    for i, feature in enumerate(features):
        automaton.add_word(feature, i)
    automaton.make_automaton()
    if not len(automaton):
        return lambda words: set()
    return lambda words: {i for _, i in automaton.iter(f" {' '.join(words)} ")}


@dataclass
class Model:
    """Weights of the features, and the intercept."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> Callable[[str], float]:
        find, weights = finder(self.weights), list(self.weights.values())

        def score(text: str) -> float:
            z = self.bias + math.fsum(weights[i] for i in find(words_of(text)))
            return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

        return score


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of the sampled training rows, and the training rows of each label."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")) \
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("id")) != 2))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]).dropDuplicates(["id"]))  # at most 2 * max_rows small rows
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.join(chosen, "id").select("toxic", "text"), counts


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): sampled documents with the feature, by label; each batch adds up its own first."""
    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[y].update(set().union(*map(word_features, words_of(text))))
            every = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[f] for f in every], pa.int64()) for c in (counts[1], counts[0]))],
                                             ["feature", "pos", "neg"])

    return rows.mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _most_telling(counts: DataFrame, n_pos: int, n_neg: int, k: int) -> list[str]:
    """The k features with the largest log odds ratio in standard errors."""
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    ratio = F.log(p / (n_pos + 1 - p)) - F.log(q / (n_neg + 1 - q))
    top = counts.where(F.col("pos") + F.col("neg") >= MIN_DOCS).withColumn("z", F.abs(ratio) / F.sqrt(1 / p + 1 / q)) \
        .orderBy(F.desc("z"), "feature").limit(k)
    return sorted(r["feature"] for r in top.select("feature").collect())


def rewrites(features: list[str]) -> Callable[[str], Iterator[tuple[bytes, bytes, int]]]:
    """Function from a text to its rewritings that move a score: (places of the features gained, of those lost, sentences rewritten), as 32-bit numbers."""
    find, swaps = finder(features), partners()
    alone = {form: find({form}) for form in swaps}

    def packed(places: set[int]) -> bytes:
        return np.array(sorted(places), dtype="<i4").tobytes()

    def of(text: str) -> Iterator[tuple[bytes, bytes, int]]:
        words = words_of(text)
        named = sorted(words & swaps.keys())
        sentences = [words_of(s) for s in SENTENCE.findall(text)] if named else []
        for form in named:
            rest = find(words - {form})
            before, times = rest | alone[form], sum(form in s for s in sentences)
            for other in swaps[form]:
                after = rest | alone[other]
                if after != before:
                    yield packed(after - before), packed(before - after), times

    return of


def _examples(rows: DataFrame, features: list[str]) -> tuple[list[tuple[int, np.ndarray]], Counter]:
    """(toxic, places of the features the text holds) of the sampled rows, and the sentences of each rewriting (gained, lost), added up by batch."""
    def run(batches):
        find, rewritten = finder(features), rewrites(features)
        for batch in batches:
            toxic, held, swaps = [], [], Counter()
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                toxic.append(y)
                held.append(np.array(sorted(find(words_of(text))), dtype="<i4").tobytes())
                for gained, lost, times in rewritten(text):
                    swaps[gained, lost] += times
            none = [None] * len(swaps)
            columns = (toxic + none, held + [g for g, _ in swaps], [None] * len(toxic) + [x for _, x in swaps], [None] * len(toxic) + list(swaps.values()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["toxic", "held", "lost", "sentences"])

    examples, swaps = [], Counter()
    for r in rows.mapInArrow(run, "toxic int, held binary, lost binary, sentences long").collect():  # of the bounded sample
        if r["lost"] is None:
            examples.append((r["toxic"], np.frombuffer(r["held"], "<i4")))
        else:
            swaps[bytes(r["held"]), bytes(r["lost"])] += r["sentences"]
    return examples, swaps


def _changes(swaps: Counter, features: list[str]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(places gained, places lost, weight) of every rewriting, those of the bare terms included."""
    swaps, rewritten = Counter(swaps), rewrites(features)
    for form in partners():
        for gained, lost, times in rewritten(form):
            swaps[gained, lost] += times
    return [(np.frombuffer(g, "<i4"), np.frombuffer(x, "<i4"), float(n)) for (g, x), n in sorted(swaps.items())]


def _optimise(y: np.ndarray, held: list[np.ndarray], weight: np.ndarray, d: int, swaps) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient."""
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    place = np.concatenate([*held, np.empty(0, np.int64)]).astype(np.int64)
    whole = sum(s[2] for s in swaps)
    of = np.repeat(np.arange(len(swaps)), [len(g) + len(x) for g, x, _ in swaps])
    moved_at = np.concatenate([p for g, x, _ in swaps for p in (g, x)] + [np.empty(0, np.int64)]).astype(np.int64)
    by = np.concatenate([np.repeat((1.0, -1.0), (len(g), len(x))) for g, x, _ in swaps] + [np.empty(0)])
    shares = np.array([s[2] / whole for s in swaps])
    weight = weight / weight.sum()

    def even(w):
        """Half the slope of the mean squared change of the score."""
        if not len(of):
            return np.zeros(d)
        change = np.bincount(of, by * w[moved_at], len(swaps))
        return np.bincount(moved_at, by * (shares * change)[of], d)

    def scores(w):
        return np.bincount(owner, w[place], len(held)) if len(place) else np.zeros(len(held))

    probe, norm = np.ones(d) / math.sqrt(max(d, 1)), 0.0  # largest curvature, by power iteration
    for _ in range(15):
        v = np.bincount(place, (weight * scores(probe))[owner], d) / 4 + COUNTERFACTUAL * even(probe) if len(place) else probe
        norm = float(np.linalg.norm(v)) or 1.0
        probe = v / norm
    rate = 1 / (1.1 * norm + L2 + 0.25)
    base = float((weight * y).sum())
    b = math.log(max(base, 1e-6) / max(1 - base, 1e-6))
    w = np.zeros(d)
    w0, b0, t = w, b, 1.0
    for _ in range(STEPS):
        t1 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        wx, bx = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        p = 1 / (1 + np.exp(-np.clip(scores(wx) + bx, -30, 30)))
        error = weight * (p - y)
        slope = (np.bincount(place, error[owner], d) if len(place) else np.zeros(d)) + L2 * wx + COUNTERFACTUAL * even(wx)
        moved = wx - rate * slope
        w0, b0, t = w, b, t1
        w = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)
        b = bx - rate * float(error.sum())
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """The classifier of the training rows of ``labels`` (see the module's docstring).

    Labels other than 0 and 1, NULL ids and ids without a document are left out.  Without both labels the score is a constant: the label's share, 0 without labels.
    """
    rows, counts = _sample(docs, labels, id_col, text_col, label_col, max_rows)
    total = sum(counts.values())
    if len(counts) < 2:
        return Model(30.0 if counts.get(1) else -30.0)
    features = _most_telling(_feature_counts(rows), min(counts[1], max_rows), min(counts[0], max_rows), max_features)
    examples, swaps = _examples(rows, features)
    y = np.array([toxic for toxic, _ in examples], dtype=float)
    if not len(features) or y.min(initial=1) == y.max(initial=0):
        return Model(math.log(counts[1] / counts[0]))
    share = {label: counts[label] / total / max(1.0, float((y == label).sum())) for label in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    w, b = _optimise(y, [held for _, held in examples], weight, len(features), _changes(swaps, features))
    return Model(float(b), {features[i]: float(w[i]) for i in np.flatnonzero(w)})


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0 to 1, higher where label 1 is likelier.

    A NULL or empty text has the score of a text without features; a NULL id stays; repeated rows give repeated rows; an empty table
    gives no rows; other columns are not read.  One narrow pass, no shuffle.
    """
    def make():
        score = model.scorer()
        return lambda text: [(score(text),)]

    return map_texts(texts(docs, id_col, text_col), id_col, [T.StructField("score", T.DoubleType())], make)


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns; NULL and empty texts have the score of a text without features."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()  # once a task
        for text in batches:
            yield text.fillna("").map(score).astype("float64")

    name = fresh("score")
    return docs.withColumn(name, scored(F.col(f"`{text_col}`"))).where(F.col(name) < threshold).drop(name)
