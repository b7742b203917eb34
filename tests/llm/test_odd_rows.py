"""Every operator on rows that real tables hold: nulls, blanks, very long texts, ties, repeats, clashing names."""

import re
import zlib
from collections import Counter

import pytest
from compare import differences
from force import shipped  # noqa: F401
from pyspark.sql import functions as F

import duckdb
from pacegrid.llm import exact, grammar, licence, mixing, near, nearest, packing, quality, tokens, toxicity
from pacegrid.llm.queries import PATH

SPACE = "[\x20\x09-\x0d]"
TEXTS = [None, "", " \t\n", "one two", "one  two ", "onetwo", "a b c d e f g h", "a b c d e f g h", "a b　c\x1cd", "é́ 日本語 😀\r\nx", "word " * 30_000, "<|endoftext|> </s> ▁x"]
#: doc_id, text, lang, source, n_chars, and columns that operators might use themselves
ROWS = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
ROWS += [(3, "one two", "en", "s0", 7), (3, "one two", "en", "s0", 7), (None, "one two", "en", "s1", 7), (6, "another text of the same id", None, None, 27)]
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size own row id mark key range null name taken target score features y fold digest n copies place run points shard start ids length piece __own __id __deal".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (7, None, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", ROWS)
    return con


def bare(text):
    return re.sub(SPACE, "", text or "")


def test_exact(docs, none, con):
    got = exact.group_exact(docs).collect()
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i))
    best = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    expected = Counter((i, best[bare(t)][2], len(groups[bare(t)])) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert Counter(bare(r["text"]) for r in kept.collect()) == Counter(list(groups))
    assert kept.where("own <> 'own own' OR row <> 'own row'").isEmpty()
    assert exact.group_exact(none).count() == 0 and exact.keep_first(none).count() == 0


def test_mix(docs, none, con):
    assert [d for d in differences("mix", mixing.mix(docs), con, mixing.SQL) if "type of" not in d] == []
    got = mixing.mix(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(re.findall("[^\x20\x09-\x0d]+", r["text"])) for r in mixed.collect())
    assert words == sum(r["taken"] for r in got)
    assert mixed.where("size <> 'own size' OR `key` <> 'own key'").isEmpty()
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_near(docs, none):
    got = near.near_groups(docs).collect()
    sets = {}
    for i, t, *_ in ROWS:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        n = min(5, len(w))
        sets.setdefault(frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if n else frozenset(), []).append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    assert Counter((r["doc_id"], r["class_id"], r["copies"]) for r in got) == Counter((i, least(v), len(v)) for v in sets.values() for i in v)
    assert {r["n_links"] for r in got} == {0}
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(sets)
    assert near.near_groups(none).count() == 0 and near.keep_one(none).count() == 0


def test_tokens(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH("piece_bpe_32k.model"))
    expected = Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in ROWS)
    got = tokens.token_counts(docs, PATH("piece_bpe_32k.model"))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == expected
    assert got.where("over_limit <> (n_tokens > 4096)").isEmpty()
    assert tokens.token_counts(none, PATH("piece_bpe_32k.model")).count() == 0


def encoded(name, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH(name))
    return [(i, library.encode(t or "", add_special_tokens=False).ids + [end]) for i, t, *_ in ROWS]


def raw(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_packing(docs, none):
    got = packing.packed_documents(docs, PATH("word_bpe_49k.json")).collect()
    expected = Counter()
    for i, ids in encoded("word_bpe_49k.json", 1):
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected[i, n, at, len(part), zlib.crc32(raw(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed_documents(none, PATH("word_bpe_49k.json")).count() == 0
    whole = packing.sequences(packing.pack(packing.pieces(docs, PATH("word_bpe_49k.json"))))
    assert whole.where("length * 4 <> octet_length(ids)").isEmpty() and whole.count() == len(bins)


def test_token_files(spark, docs, none):
    files = grammar.write(docs, PATH("byte_bpe_50k.json"), block=1000)
    got = grammar.read(spark, files).orderBy("start").collect()
    order = sorted(zip(ROWS, encoded("byte_bpe_50k.json", 2)), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] or ""))
    at = 0
    for r, (_, (i, ids)) in zip(got, order, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (i, at, len(ids), raw(ids))
        at += len(ids)
    one = grammar.document(spark, files, 10).collect()
    assert [r["ids"] for r in one] == [ids for i, ids in encoded("byte_bpe_50k.json", 2) if i == 10]
    assert grammar.read(spark, grammar.write(none, PATH("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("scored", [quality.quality, toxicity.toxicity])
def test_classifiers(spark, docs, none, labels, scored):
    for given in (labels, labels.limit(0)):
        got = scored(docs, given).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in ROWS)
        assert all(0 <= r["score"] <= 1 and r["held_out"] in (True, False) for r in got)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
        assert scored(none, given).count() == 0
    limit = 0.3 if scored is quality.quality else 0.5
    assert all(r["predicted"] == int(r["score"] >= limit) for r in got)
    assert len({r["score"] for r in got if not bare(r["text"] if "text" in r else "")}) >= 1


def test_accepted_keeps_columns(docs, none, labels):
    assert quality.accepted(docs, labels).columns == docs.columns and quality.accepted(none, labels).count() == 0


def test_licences(docs, none):
    got = licence.licences(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in ROWS)
    assert {r["license"] for r in got} == {licence.UNKNOWN}
    assert licence.licences(none).count() == 0


def test_nearest(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (2, [1.0, 1.0]), (100, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(2), "dim": F.lit(3), "tile": F.lit(4)})
    got = {}
    for r in nearest.nearest(df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == {0: [(1, 100, 0.0), (2, 1, 1.0), (3, 2, 1.0)], 100: [(1, 0, 0.0), (2, 1, 1.0), (3, 2, 1.0)]}
    assert nearest.nearest(df.limit(0)).count() == 0
