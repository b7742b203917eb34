"""Text quality from random-indexing word vectors (method of the dealt operator 3).

A word's index vector is sparse and drawn from its hash; its word vector is the sum of the index
vectors of its neighbours over all documents that are not held out. Words live in a fixed number of
hash buckets.
A white-space token counts as up to three words: its letters, its shape, and its end marks; a word
that repeats the one before it is followed by a mark of repetition. The mean and the spread of a
document's word vectors go through a two-layer network; a temperature fitted on rows that the
network has not seen calibrates its probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.llm.labelled import held_out, sample
from pacegrid.llm.tables import whole

BUCKETS, WIDTH, SPARSE, WINDOW = 1 << 15, 48, 6, 2
#: A word met less often than this has no vector: its neighbours are chance.
LEAST = 10
HIDDEN, EPOCHS, RATE, DECAY = 24, 150, 0.02, 1e-2
ACCEPT = 0.3
REMEMBERED = 300_000
#: Words whose neighbours are added up at a time.
AT_ONCE = 200_000
#: Characters of a word; a longer token is read as consecutive pieces of so many.
PIECE = 64
_LETTERS = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
NOTHING, AGAIN = 0, 1  # buckets: no word, and a word like the one before


def _bucket(kind: str, word: str) -> int:
    return 2 + zlib.crc32(f"{kind}{word}".encode()) % (BUCKETS - 2)


def words_of(token: str) -> bytes:
    """Buckets of letters, shape and marks, as three 32-bit numbers; of each piece, if a token is long."""
    if len(token) > PIECE:
        return b"".join([words_of(token[at : at + PIECE]) for at in range(0, len(token), PIECE)])
    before, body, after = _LETTERS.match(token).groups()
    shape = "none"
    if body:
        shape = "upper" if body.isupper() and len(body) > 1 else "title" if body[0].isupper() else "lower" if body.islower() else "other"
        shape += "+digit" if any(map(str.isdigit, body)) else ""
    marks = before[:4] + "_" + after[:4]
    found = (_bucket("w", body.lower()) if body else NOTHING, _bucket("s", shape), _bucket("m", marks) if marks != "_" else NOTHING)
    return np.asarray(found, "<i4").tobytes()


class Reader:
    """Texts to arrays of buckets, three to a token or piece of one; remembers tokens."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        get = self.known.get
        got = list(map(get, tokens))
        if None in got:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known.update((t, words_of(t)) for t in set(tokens) if len(t) <= PIECE and t not in self.known)
            # long tokens seldom repeat, and would make the memory large
            got = [get(t) or words_of(t) for t in tokens]
        return np.frombuffer(b"".join(got), "<i4").reshape(-1, 3)


def stream(found: np.ndarray) -> np.ndarray:
    """The words in reading order, with marks of repetition; no place for absent ones."""
    again = np.zeros(len(found), np.int32)
    if len(found) > 1:
        again[1:] = np.where((found[1:, 0] == found[:-1, 0]) & (found[1:, 0] != NOTHING), AGAIN, NOTHING)
    words = np.column_stack([found, again]).ravel()
    return words[words != NOTHING]


def index_vectors(buckets: int = BUCKETS, width: int = WIDTH, sparse: int = SPARSE) -> np.ndarray:
    """Row b: ``sparse`` places of +1 or -1, drawn once for bucket b."""
    draw = np.random.default_rng(42)
    out = np.zeros((buckets, width), np.float32)
    places = draw.random((buckets, width)).argsort(1)[:, :sparse]
    np.put_along_axis(out, places, draw.choice(np.float32([-1, 1]), (buckets, sparse)), 1)
    return out


def joined(texts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The words of many texts in one array, with so much of nothing between them that no two texts meet."""
    parts, size, apart = [], 0, np.full(WINDOW, NOTHING, np.int32)
    for words in texts:
        parts += [words, apart]
        size += len(words) + WINDOW
        if size >= AT_ONCE:
            yield np.concatenate(parts)
            parts, size = [], 0
    if parts:
        yield np.concatenate(parts)


def neighbours(words: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the index vectors (their places and signs) of the words up to ``WINDOW`` away, per bucket.

    Pairs of words are counted first, so an index vector is added once a pair, not once a place.
    """
    pairs = [words[:-away].astype(np.int64) * BUCKETS + words[away:] for away in range(1, WINDOW + 1)]
    pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = np.divmod(pairs, BUCKETS)
    some = (a != NOTHING) & (b != NOTHING)
    a, b, times = a[some], b[some], times[some]
    sums = np.zeros(BUCKETS * WIDTH)
    for own, other in ((a, b), (b, a)):
        cells = own[:, None] * WIDTH + places[other]
        sums += np.bincount(cells.ravel(), (signs[other] * times[:, None]).ravel(), BUCKETS * WIDTH)
    return sums.reshape(BUCKETS, WIDTH)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Sums of neighbours' index vectors per bucket, over all rows of ``texts``.

    Each task adds up its own rows and gives one row per bucket it has met, Spark adds those up. The
    sums are whole numbers, so they are the same in any order.
    """
    names = [f"v{i}" for i in range(WIDTH)]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, index = Reader(), index_vectors()
        index[NOTHING] = 0
        places = np.abs(index).argsort(1)[:, -SPARSE:]
        signs = np.take_along_axis(index, places, 1).astype(float)
        sums, times = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS, np.int64)
        for words in joined(stream(read(text)) for batch in batches for text in batch["text"]):
            times += np.bincount(words, minlength=BUCKETS)
            sums += neighbours(words, places, signs)
        times[NOTHING] = 0
        met = np.flatnonzero(times)
        for at in range(0, len(met), 4096):
            some = met[at : at + 4096]
            yield pd.DataFrame(sums[some].astype(np.int64), columns=names).assign(bucket=some, n=times[some])

    kinds = ", ".join(f"{c} long" for c in [*names, "bucket", "n"])
    rows = texts.select("text").mapInPandas(gather, kinds)
    total = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in [*names, "n"]])
    out, met = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS, np.int64)
    for bucket, n, *v in total.select("bucket", "n", *names).collect():  # at most BUCKETS rows
        out[bucket], met[bucket] = v, n
    out[met < LEAST] = 0
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0).astype(np.float32)


def pooled(read: Reader, vectors: np.ndarray, text: str | None) -> np.ndarray:
    """Mean of the word vectors, mean absolute value, share of each kind of word; zeros if there is none."""
    words = stream(read(text))
    if not len(words):
        return np.zeros(2 * WIDTH + 2, np.float32)
    # a very long text is one row of counts per distinct word, not one row per word
    distinct, times = np.unique(words, return_counts=True)
    rows = vectors[distinct]
    share = (times / len(words)).astype(np.float32)
    return np.concatenate([share @ rows, share @ np.abs(rows), [share[distinct == AGAIN].sum(), len(distinct) / len(words)]]).astype(np.float32)


class Network:
    """One hidden layer, fitted by Adam on all rows at once; rows of either label weigh the same in sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 42):
        draw = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        self.parts = [draw.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        self.temperature, self.shift = 1.0, 0.0
        x = self._scaled(x)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        for step in range(1, EPOCHS + 1):
            a, b, c, d = self.parts
            z = x @ a + b
            h = np.maximum(z, 0)
            off = (1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30))) - y) * weight
            back = off[:, None] * c * (z > 0)
            slopes = [x.T @ back + DECAY * a, back.sum(0), h.T @ off + DECAY * c, np.array([off.sum()])]
            for p, g, m, v in zip(self.parts, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.maximum(self._scaled(x) @ a + b, 0) @ c + d

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss on rows not fitted on."""
        z = self.logit(x)
        if len(set(y.tolist())) < 2:
            return
        losses = {t: np.logaddexp(0, np.where(y == 1, -z, z) / t).mean() for t in np.geomspace(0.5, 8, 41)}
        self.temperature = min(losses, key=losses.get)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network] | None:
    """Word vectors and network; None where the labels do not hold both values."""
    rows = sample(docs, labels, "quality")
    if rows.select("y").distinct().count() < 2:
        return None
    vectors = word_vectors(docs.where(~held_out(F.col("doc_id"))))
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader()
        for batch in batches:
            x = [pooled(read, shared.value, t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "fold": batch["fold"], "x": x})

    got = rows.mapInPandas(features, "y int, fold int, x binary").toPandas()  # bounded by the sample
    shared.unpersist()
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float)
    y, fold = got["y"].to_numpy(float), got["fold"].to_numpy()
    order = np.lexsort((*x.T[:3], y))  # the same sums whichever task gave which row
    x, y, fold = x[order], y[order], fold[order]
    fitted, unseen = fold != 0, fold == 0
    if len(set(y[fitted])) < 2:
        fitted = np.ones(len(y), bool)
    network = Network(x[fitted], y[fitted])
    network.calibrate(x[unseen], y[unseen])
    return vectors, network


def scorer(model: tuple[np.ndarray, Network] | None, spark) -> Column:
    """A function of text columns; without a model every text scores 0.5."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = Reader()
        for texts in batches:
            if shared.value is None:
                yield pd.Series(0.5, index=texts.index)
                continue
            vectors, network = shared.value
            out = [network.score(np.stack([pooled(read, vectors, t) for t in texts.iloc[at : at + 512]]).astype(float)) for at in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(out) if out else np.empty(0), index=texts.index)

    return score


def quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null counts as empty, and an empty text has a score like any other. Only text enters a score.
    Repeated rows stay repeated. Without labels of both values every score is 0.5. An empty table
    gives an empty result.
    """
    score = scorer(fit(docs, labels), docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    score = scorer(fit(docs, labels), docs.sparkSession)
    return whole(docs).withColumn("score", score("row.text")).where(F.col("score") >= accept).select("row.*")
