"""The registered queries of this subpackage: each operator over its whole table, and its SQL."""

from __future__ import annotations

import public_tokenizers

from pacegrid.llm import (
    audit,
    exact,
    grammar,
    licence,
    mixing,
    near,
    nearest,
    packing,
    quality,
    simhash,
    tokens,
    toxicity,
    trie,
)
from pacegrid.llm.tables import ship, table

#: Where the public vocabulary files are.
PATH = public_tokenizers.path


def op1_ngram_jaccard_join(spark, folder):
    ship(spark)
    return near.near_groups(table(spark, folder, "documents"))


def op2_license_scan(spark, folder):
    return licence.licences(table(spark, folder, "documents"))


def op3_quality(spark, folder):
    ship(spark)
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_source_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


def op5_sequence_packing(spark, folder):
    ship(spark)
    return packing.packed_documents(table(spark, folder, "documents"), PATH("word_bpe_49k.json"))


def op6_exact_dedup(spark, folder):
    return exact.group_exact(table(spark, folder, "documents"))


def op7_token_files(spark, folder):
    ship(spark)
    files = grammar.write(table(spark, folder, "documents"), PATH("byte_bpe_50k.json"))
    return grammar.read(spark, files, whole=False)


def op8_nearest_neighbours(spark, folder):
    ship(spark)
    return nearest.nearest(table(spark, folder, "embeddings"))


def op9_toxicity(spark, folder):
    ship(spark)
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_token_counts(spark, folder):
    ship(spark)
    return tokens.token_counts(table(spark, folder, "documents"), PATH("piece_bpe_32k.model"))


def op11_simhash(spark, folder):
    ship(spark)
    return simhash.near_components(table(spark, folder, "documents"))


def op12_filter_audit(spark, folder):
    ship(spark)
    return audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_prefix_trie(spark, folder):
    ship(spark)
    return trie.prefix_trie(table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (
        op1_ngram_jaccard_join,
        op2_license_scan,
        op3_quality,
        op4_source_mix,
        op5_sequence_packing,
        op6_exact_dedup,
        op7_token_files,
        op8_nearest_neighbours,
        op9_toxicity,
        op10_token_counts,
        op11_simhash,
        op12_filter_audit,
        op13_prefix_trie,
    )}

SQL = {
    "op4_source_mix": mixing.SQL,
    "op6_exact_dedup": exact.SQL,
    "op8_nearest_neighbours": nearest.SQL,
    "op12_filter_audit": audit.SQL,
    "op13_prefix_trie": trie.SQL,
}
