"""Toxicity by gradient-boosted trees over dense features (method of the dealt operator 9).

The features of a text are densities of lexicon words, how near they stand to second-person words,
and rates of capitals, punctuation and obfuscated words. The lexicon (words and word beginnings that
mark toxic texts) is learned from the labelled sample; for fitting the trees, a row's features come
from a lexicon learned without the row's fold. Isotonic regression on a fold that the trees have not
seen calibrates their probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.llm.labelled import FOLDS, held_out, sample
from pacegrid.session import settle

ACCEPT = 0.5
#: Lexicon: evidence (log-likelihood ratio) and odds an entry needs, and its most entries.
EVIDENCE, ODDS, ENTRIES = 20.0, 4.0, 4000
#: A text of a chance word or two should not count: weights of entries are log odds up to this.
MOST = 6.0
TREES, DEPTH, STEP = 20, 3, 0.3
NEAR = 5
REMEMBERED = 300_000
#: Characters of a word; a longer token is read whole, by its runs of letters and their n-grams, and has a row for each piece of so many.
PIECE = 64
#: Fold whose rows calibrate.
CALIBRATE = 4

#: Words that address the reader, in the languages of the tables. Fixed values.
SECOND_PERSON = "you your yours yourself you're u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer sie ihr ihnen tú usted ustedes ti tus su sus vosotros".split()

_PLAIN = str.maketrans("0134578@$!", "oieastbasi")
_INNER = re.compile(r"(?<=\w)[\W_]+(?=\w)")
_LONG = re.compile(r"(.)\1{2,}")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_RUN = re.compile(r"[^\W_]+")
_DIGIT_INSIDE = re.compile(r"[^\W\d_][\d@$!*]+[^\W\d_]")
#: Of a token: weight, second person, letters, capitals, marks (! ?), obfuscated, wholly capital.
_KIND = np.dtype("<f4")
_N = 7
FEATURES = 16


def entries(token: str) -> tuple[str, ...]:
    """What of a token may be in the lexicon: the plain word, and its beginnings of 4 to 6 letters.

    Of a long token, all that ``placed`` gives.
    """
    if len(token) > PIECE:
        return tuple(dict.fromkeys(e for _, e in placed(token)))
    word = _EDGES.sub("", token).lower()
    if _DIGIT_INSIDE.search(word):
        word = word.translate(_PLAIN)
    word = _LONG.sub(r"\1", _INNER.sub("", word) if "'" not in word and "’" not in word else word)
    return (word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) >= n)) if word else ()


def placed(token: str) -> Iterator[tuple[int, str]]:
    """Place and entry of all in a long token that may be in the lexicon.

    Runs of letters and digits count as words. As words may be joined without a mark, the six letters
    from any place count as a beginning; of letters without case (in writing without blanks), two to
    four from any place count as a word.
    """
    for found in _RUN.finditer(token):
        run, start = found.group(), found.start()
        if len(run) <= PIECE:
            yield from ((start, e) for e in entries(run))
        for i, c in enumerate(run):
            if c.lower() != c.upper():
                if len(run) >= i + 6:
                    yield start + i, run[i : i + 6].lower() + "-"
            elif not c.isdigit():
                yield from ((start + i, run[i : i + n].lower()) for n in (2, 3, 4) if len(run) >= i + n)


class Tokens:
    """Texts to arrays of token features under one lexicon; remembers tokens."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known, self.second = lexicon, {}, set(SECOND_PERSON)

    def _of(self, token: str) -> bytes:
        if len(token) <= PIECE:
            return self._row(token, max((self.lexicon.get(e, 0.0) for e in entries(token)), default=0.0))
        weights = [0.0] * -(-len(token) // PIECE)
        for at, e in placed(token):
            weights[at // PIECE] = max(weights[at // PIECE], self.lexicon.get(e, 0.0))
        return b"".join([self._row(token[i * PIECE : (i + 1) * PIECE], w) for i, w in enumerate(weights)])

    def _row(self, token: str, weight: float) -> bytes:
        body = _EDGES.sub("", token)
        odd = bool(_DIGIT_INSIDE.search(body) or _LONG.search(body) or (_INNER.search(body) and not re.search(r"['’-]", body)))
        capitals = sum(map(str.isupper, body))
        letters = sum(map(str.isalpha, body))
        row = (weight, body.lower() in self.second, letters, capitals, token.count("!") + token.count("?"), odd, capitals == letters > 1)
        return np.asarray(row, _KIND).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        got = list(map(self.known.get, tokens))
        if None in got:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known.update((t, self._of(t)) for t in set(tokens) if len(t) <= PIECE and t not in self.known)
            # long tokens seldom repeat, and would make the memory large
            got = [self.known.get(t) or self._of(t) for t in tokens]
        return np.frombuffer(b"".join(got), _KIND).reshape(-1, _N)


def features(found: np.ndarray) -> list[float]:
    """The dense features of a text; zeros for one without a token."""
    n = len(found)
    if not n:
        return [0.0] * FEATURES
    weight = found[:, 0].astype(float)
    hits = np.flatnonzero(weight > 0)
    strong = int((weight >= 3).sum())
    you = np.flatnonzero(found[:, 1])
    nearest, close = 0.0, 0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
        nearest, close = 1 / (1 + float(gap.min())), int((gap <= NEAR).sum())
    letters, capitals, marks, odd, shouted = (float(found[:, i].sum()) for i in range(2, 7))
    odd_hits = float((found[hits, 5]).sum())
    top = np.sort(weight)[::-1][:3]
    return [
        len(hits) / n, math.log1p(len(hits)), strong / n, math.log1p(strong), weight.sum() / n, float(weight.max()), float(top.mean()),
        len(you) / n, nearest, close / n, capitals / max(letters, 1.0), shouted / n, marks / n, odd / n, odd_hits / n, math.log1p(n),
    ]


def learn_lexicon(rows: DataFrame) -> dict[int, dict[str, float]]:
    """Lexicons by fold left out; -1 leaves out none. Counts are of texts, over the bounded sample."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (y, fold), some in batch.groupby(["y", "fold"]):
                times: Counter[str] = Counter()
                for text in some["text"]:
                    times.update({e for t in set((text or "").split()) for e in entries(t)})
                if times:
                    found = pd.Series(list(times), dtype=object)
                    yield pd.DataFrame({"entry": found, "y": int(y), "fold": int(fold), "n": list(times.values())})

    totals = {(r["y"], r["fold"]): r["n"] for r in rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = [sum(n for (y, _), n in totals.items() if y == side) for side in (0, 1)]
    if not all(size):
        return {fold: {} for fold in range(-1, FOLDS)}
    counted = rows.select("y", "fold", "text").mapInPandas(count, "entry string, y int, fold int, n long")
    by = [F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("fold") == f), F.col("n"))), F.lit(0)).alias(f"c{y}{f}") for y in (0, 1) for f in range(FOLDS)]
    table = counted.groupBy("entry").agg(*by)
    toxic, other = (sum((F.col(f"c{y}{f}") for f in range(FOLDS)), F.lit(0)) for y in (1, 0))
    table = table.where((toxic >= 3) & (toxic * size[0] >= ODDS * other * size[1])).orderBy((toxic / size[1] - other / size[0]).desc(), "entry").limit(ENTRIES)

    def lexicon(counts, left_out: int) -> dict[str, float]:
        n = [sum(v for (y, f), v in totals.items() if y == side and f != left_out) for side in (0, 1)]
        kept = {}
        for row in counts:
            b, a = (sum(row[f"c{y}{f}"] for f in range(FOLDS) if f != left_out) for y in (0, 1))
            if not a or not all(n):
                continue
            share = n[1] / (n[0] + n[1])
            evidence = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
            odds = ((a + 0.5) / (n[1] + 1)) / ((b + 0.5) / (n[0] + 1))
            if evidence >= EVIDENCE and odds >= ODDS:
                kept[row["entry"]] = min(MOST, math.log(odds))
        return kept

    counts = table.collect()  # at most ENTRIES rows
    return {fold: lexicon(counts, fold) for fold in range(-1, FOLDS)}


def featurizer(spark, lexicons: dict[int, dict[str, float]]) -> Column:
    """A function of text (and the fold whose lexicon applies) that gives the features."""
    shared = spark.sparkContext.broadcast(lexicons)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        readers = {fold: Tokens(words) for fold, words in shared.value.items()}
        for texts, folds in batches:
            yield pd.Series([features(readers[f](t)) for t, f in zip(texts, folds)], index=texts.index, dtype=object)

    return of


class Model:
    """Lexicon, trees and calibration, fitted on the sample; ``base`` alone where a label is absent."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        rows = sample(docs, labels, "toxic")
        self.lexicons = learn_lexicon(rows)
        spark = docs.sparkSession
        dense = array_to_vector(featurizer(spark, self.lexicons)("text", "fold")).alias("features")
        rows = settle(rows.select(F.col("y").cast("double").alias("label"), "fold", dense))
        counts = {(r["label"], r["late"]): r["n"] for r in rows.groupBy("label", (F.col("fold") == CALIBRATE).alias("late")).agg(F.count(F.lit(1)).alias("n")).collect()}
        some = [sum(n for (y, _), n in counts.items() if y == side) for side in (0.0, 1.0)]
        self.base = some[1] / sum(some) if sum(some) else 0.5
        self.trees = self.steps = None
        if not all(some):
            return
        both_late = all(counts.get((y, True)) for y in (0.0, 1.0)) and all(counts.get((y, False)) for y in (0.0, 1.0))
        early, late = (rows.where(F.col("fold") != CALIBRATE), rows.where(F.col("fold") == CALIBRATE)) if both_late else (rows, rows)
        self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=42).fit(early)
        raw = self._raw(late)
        self.steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw.select("raw", "label"))

    def _raw(self, rows: DataFrame) -> DataFrame:
        rows = self.trees.transform(rows)
        return rows.withColumn("raw", vector_to_array("probability")[1])

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``score`` to rows with a ``text``."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.base)))
        dense = array_to_vector(featurizer(rows.sparkSession, {-1: self.lexicons[-1]})("text", F.lit(-1)))
        rows = self.steps.transform(self._raw(rows.withColumn("features", dense)))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
        return rows.withColumn("score", score).drop("features", "rawPrediction", "probability", "prediction", "raw")


def toxicity(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null counts as empty, and an empty text has a score like any other. Only text enters a score.
    Repeated rows stay repeated, other columns are not read. Without labels of both values every
    score is the share of toxic labels (0.5 without any). An empty table gives an empty result.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    rows = Model(docs, labels).score(rows)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))
