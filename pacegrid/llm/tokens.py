"""Token counts by a whole-token shortcut (method of the dealt operator 10).

Offline, each vocabulary string is given to the library alone: those that come back as one token are
counted by a table look-up, only other pre-tokens are merged by the library, once per distinct piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.memo import Memo, held

BLANK = "▁"  # the mark that the vocabulary writes for a space


def _cut(text: str) -> list[str] | None:
    """Pre-tokens: words without the one space before them, or with the line feed before them.

    No vocabulary string holds a mark after another character, nor a line feed, so no token reaches
    over such a cut. Other spacing, and the mark itself in a text, go to the library whole.
    """
    if not text or text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
        return None
    if BLANK in text or "\0" in text:
        return None
    return text.replace("\n", " \n").split(" ")


def proven(strings: list[str], is_single) -> set[str]:
    """Of the vocabulary's strings that open a word, those that encode alone as one token."""
    words = [s[1:] for s in strings if len(s) > 1 and s[0] == BLANK and BLANK not in s[1:]]
    return {w for w, one in zip(words, is_single(words)) if one}


def counter(path: str) -> Memo:
    """Token counts of texts by a ``.model`` file, from the worker's memory."""
    return held("counts", path, make=lambda: _counter(path))


def _counter(path: str) -> Memo:
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    strings = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    crossing = any(BLANK in s.lstrip(BLANK) or "\n" in s for s in strings)

    def whole(text: str) -> int:
        return len(library.encode(text, num_threads=1))

    single = proven(strings, lambda words: [len(x) == 1 for x in library.encode(words, num_threads=1)])

    def ask(piece: str) -> int:
        if piece in single:
            return 1
        # before a line feed the library puts a mark of its own, which the text does not have there
        return whole(piece) - piece.startswith("\n")

    return Memo((lambda text: None) if crossing else _cut, ask, whole, sum)


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of each text as the library for the ``.model`` file gives them; null counts as empty."""

    @F.arrow_udf("long")
    def count(texts):
        import pyarrow as pa

        return pa.array(list(counter(path)(t.as_py() for t in texts)), pa.int64())

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, a row per row of ``docs``.

    Nulls and empty texts have no bytes and no tokens; repeated rows and ids stay repeated; other
    columns are not read. An empty table gives an empty result. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
