"""Token counts of texts under a public subword vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Vocabulary file and pre-tokenizer pattern of the byte-level encoding; both are parameters of the callers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at once, at least; a longer text is cut where no token crosses.
PIECE = 100_000
_BETWEEN_WORDS = re.compile(r"(?<=\w) (?=\w)")
#: Setting of the session that names another vocabulary file.
VOCABULARY_SETTING = "spark.drawforge.vocabulary"


def _pieces(text: str) -> Iterator[str]:
    """`text` in pieces of at least PIECE characters, each cut before a blank between two words: there every token ends.

    Where no such blank follows, the rest is one piece.
    """
    at = 0
    while len(text) - at > PIECE:
        found = _BETWEEN_WORDS.search(text, at + PIECE)
        # letters and digits in the sense of the pre-tokenizer
        while found and not (text[found.start() - 1].isalnum() and text[found.end()].isalnum()):
            found = _BETWEEN_WORDS.search(text, found.end())
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def token_counts(documents: DataFrame, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens) of every document; a null text has no tokens.

    The vocabulary is read once on the driver and goes to the executors with the job. Its path is the argument, else
    the session's VOCABULARY_SETTING, else VOCABULARY.
    """
    vocabulary = vocabulary or documents.sparkSession.conf.get(VOCABULARY_SETTING, VOCABULARY)
    with open(vocabulary, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines()) if a}
        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for frame in frames:
            sizes = [sum(len(encode(p)) for p in _pieces(t)) if t else 0 for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "tokens": sizes})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, tokens long")
