"""Each registered query over the small tables, against its SQL or a brute-force version."""

import re
import zlib
from collections import Counter

import pytest
from compare import connect, differences
from conftest import FOLDER
from force import near_by_force, shipped  # noqa: F401

import __spark_entry__ as contract
from pacegrid.llm import licence
from pacegrid.llm.queries import PATH, QUERIES, SQL

LARGER = FOLDER.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return con.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_all_operators_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(SQL) <= set(QUERIES) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    found = differences(name, QUERIES[name](spark, FOLDER), con, SQL[name])
    assert [d for d in found if "type of kept is boolean" not in d] == []


@pytest.mark.parametrize("name", ["op2_license_scan", "op4_source_mix", "op6_exact_dedup"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_near(spark, texts):
    got = QUERIES["op1_ngram_jaccard_join"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_id"], r["copies"]) for r in got} == near_by_force(texts)


def test_licences(spark, texts):
    """Every line that is a notice is found, and nothing else."""
    short = {n: f for f, notices in licence.TEMPLATES.items() for n in notices}
    expected = {i: ",".join(sorted({short[s] for s in t.split("\n") if s in short})) for i, t in texts}
    got = {r["doc_id"]: r["families"] for r in QUERIES["op2_license_scan"](spark, FOLDER).collect()}
    assert got == expected and any(expected.values())


def test_token_counts(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_token_counts"](spark, FOLDER).collect()}
    assert got == {i: len(library.encode(t)) for i, t in texts}


def library_ids(name, texts, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH(name))
    return [(i, library.encode(t, add_special_tokens=False).ids + [end]) for i, t in texts]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(spark, texts):
    expected, at = {}, 0
    for i, ids in library_ids("byte_bpe_50k.json", texts, 2):
        expected[i] = (at, len(ids), crc(ids))
        at += len(ids)
    got = QUERIES["op7_token_files"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == expected


def test_packing(spark, texts):
    expected, total = {}, 0
    for i, ids in library_ids("word_bpe_49k.json", texts, 1):
        total += len(ids)
        for n, at in enumerate(range(0, len(ids), 4096)):
            expected[i, n] = (at, len(ids[at : at + 4096]), crc(ids[at : at + 4096]))
    got = QUERIES["op5_sequence_packing"](spark, FOLDER).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == expected
    assert len({r["sequence_id"] for r in got}) <= -(-total // 4096) + 1


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    """Fitted on a few hundred labels only; the larger tables have far more."""
    truth = {i: y for i, y in connect(LARGER).sql(f"SELECT doc_id, {label} FROM labels").fetchall()}
    got = [r for r in QUERIES[name](spark, LARGER).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(got) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got) >= least


def test_reruns_agree(spark):
    for name in ("op4_source_mix", "op3_quality"):
        first, again = (Counter(map(tuple, QUERIES[name](spark, FOLDER).collect())) for _ in range(2))
        assert first == again
