"""The pipeline, stage by stage, against brute force on what the stage before kept."""

import re
from collections import Counter

from conftest import FOLDER
from force import near_by_force, shipped  # noqa: F401

import corpus_pipeline
from pacegrid.llm import mixing, quality
from pacegrid.session import settle


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = docs
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        after[name] = (before, settle(stage(spark, before, FOLDER)))
        before = after[name][1]
        assert name == "pack_sequences" or before.columns == columns

    given, kept = after["quality_filter"]
    scores = quality.quality(given, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores if r["predicted"]}

    given, kept = after["exact_dedup"]
    best = {}
    for r in given.collect():
        key = re.sub("[\x20\x09-\x0d]", "", r["text"])
        best[key] = min(best.get(key, (0, 0)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in kept.collect()} == {i for _, i in best.values()}

    given, kept = after["near_dedup"]
    force = near_by_force([(r["doc_id"], r["text"]) for r in given.collect()])
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c for c, *_ in force.values()})

    given, kept = after["mix_sources"]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(given).collect()}
    words = Counter()
    for r in kept.collect():
        words[r["doc_id"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({i: n for i, n in taken.items() if n})

    given, packed = after["pack_sequences"]
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(r["doc_id"] for r in given.collect())
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, FOLDER))
    assert docs.count() == 0
