"""Word vectors come from all texts, not from the labelled ones alone."""

import numpy as np
from force import shipped  # noqa: F401

from pacegrid.llm import quality


def by_force(texts):
    index = quality.index_vectors()
    sums, times = np.zeros((quality.BUCKETS, quality.WIDTH)), np.zeros(quality.BUCKETS, int)
    for text in texts:
        words = quality.stream(quality.Reader()(text))
        for i, w in enumerate(words):
            times[w] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                sums[w] += index[words[j]] * (i != j)
    sums[times < quality.LEAST] = 0
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, length, out=sums, where=length > 0)


def test_unlabelled_words_have_vectors(spark):
    texts = [f"alpha beta gamma{i % 3}." for i in range(40)] + ["", "x", None]
    texts += [f"delta epsilon zeta, delta delta {i % 4}!" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert np.allclose(quality.word_vectors(docs), by_force(texts), atol=1e-6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    vectors, _ = quality.fit(docs, labels)
    bucket = np.frombuffer(quality.words_of("epsilon"), "<i4")[0]
    assert np.linalg.norm(vectors[bucket]) > 0.99
