"""Evaluation passages inside training texts: Wu-Manber search for many patterns over words.

A pattern is a run of `run` consecutive words of a passage. The shift table tells, for a block of two words at the end
of the search window, how many words the window can move on without missing a pattern; where it cannot move, the block
is the last of some pattern, and the words themselves are compared with the patterns of that suffix bucket. The tables
are flat arrays, built once for a bounded number of words and sent to the executors.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Words of passages that are searched for in one pass, about; more take more passes over the texts.
WORDS_PER_PASS = 2_000_000
#: Words of one piece of a passage; a longer one is cut, with an overlap.
PIECE_WORDS = 50_000
BLOCK = 2
_MIX, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Folding(dict):
    """Translation table for str.translate: case and accents off, letters and digits kept, all else to blanks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c).startswith("M"):
            out = ""
        else:
            base = (x for x in unicodedata.normalize("NFD", c.casefold()) if not unicodedata.category(x).startswith("M"))
            out = "".join(x if x.isalnum() else " " for x in base)
        self[code] = out
        return out


def words_of(text: str, folding: Folding) -> list[str]:
    """The words of a text: unbroken runs of letters and digits, case and accents ignored."""
    return text.translate(folding).split()


def _hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, dtype=np.uint64)


def _blocks(h: np.ndarray) -> np.ndarray:
    """Hash of the two words that end at each place; at the first place it is meaningless."""
    with np.errstate(over="ignore"):
        mixed = h * _MIX
        out = mixed ^ (mixed >> np.uint64(29))
        out[1:] += h[:-1] * _NEXT
    return out


def _runs(h: np.ndarray, ends: np.ndarray, run: int) -> np.ndarray:
    """Hash of the `run` words that end at each of `ends`."""
    out = np.zeros(len(ends), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run - 1, -1, -1):
            out = out * _MIX + h[ends - k]
            out ^= out >> np.uint64(31)
    return out


class Tables:
    """Shift table and suffix buckets of all runs of `run` words of some pieces of passages, as flat arrays.

    `keys` are the blocks of two words that are in a pattern, in order, and `shifts` how far the window may move for
    each; a block of shift 0 ends a pattern. A bucket's patterns stand in `patterns` by the hash of all their words, with
    the piece and place they come from, so that a place of a text is compared with those only that may be equal.
    """

    def __init__(self, items: list[tuple[int, str]], run: int):
        """`items` are (item, words of a piece parted by blanks), each of at least `run` words."""
        self.run = run
        self.items = np.array([i for i, _ in items], dtype=np.int64)
        self.pieces = [t for _, t in items]
        words = [t.split(" ") for t in self.pieces]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        h = _hashes([w for ws in words for w in ws])
        del words
        # place of each word in its piece: the window of the first pattern that ends behind it ends at run - 1
        place = np.arange(len(h), dtype=np.int64) - np.repeat(starts, sizes)
        inside = place >= BLOCK - 1
        keys, shifts = _blocks(h)[inside], np.maximum(run - 1 - place[inside], 0)
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, dtype=bool)
        self.keys, self.shifts = keys[first], shifts[first].astype(np.int16)
        ends = np.flatnonzero(place >= run - 1)
        found = _runs(h, ends, run)
        order = np.argsort(found, kind="stable")
        self.patterns = found[order]
        self.piece = (np.searchsorted(starts, ends[order], side="right") - 1).astype(np.int32)
        self.at = (place[ends[order]] - run + 1).astype(np.int32)

    def moves(self, blocks: np.ndarray) -> np.ndarray:
        """How far the window may move for each block at its end; 0 means that a pattern may end here."""
        at = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        return np.where(self.keys[at] == blocks, self.shifts[at], self.run - BLOCK + 1)

    def search(self, texts: list[list[str]]) -> Iterator[tuple[int, int]]:
        """(number of the text, item) of every text that contains a pattern, once each.

        All texts move their window at once: a step looks up the blocks at the ends of all windows.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        which = np.flatnonzero(sizes >= self.run)
        if not len(which) or not len(self.patterns):
            return
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = _hashes([w for t in texts for w in t])
        blocks = _blocks(h)
        end = starts[which] + self.run - 1
        stop = starts[which] + sizes[which]
        seen: set[tuple[int, int]] = set()
        while len(which):
            move = self.moves(blocks[end])
            zero = np.flatnonzero(move == 0)
            hashes = _runs(h, end[zero], self.run)
            low, high = np.searchsorted(self.patterns, hashes), np.searchsorted(self.patterns, hashes, side="right")
            for j, a, b in zip(zero[low < high], low[low < high], high[low < high]):
                text, last = int(which[j]), int(end[j] - starts[which[j]])
                words = texts[text][last - self.run + 1 : last + 1]
                for k in range(a, b):
                    item = int(self.items[self.piece[k]])
                    if (text, item) not in seen and self._words(int(self.piece[k]), int(self.at[k])) == words:
                        seen.add((text, item))
                        yield text, item
            end = end + np.maximum(move, 1)
            left = end < stop
            which, end, stop = which[left], end[left], stop[left]

    def _words(self, piece: int, at: int) -> list[str]:
        return self.pieces[piece].split(" ")[at : at + self.run]


def pieces(items: DataFrame, run: int, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item_id, words, n): the folded words of passages of at least `run` words, long ones in overlapping pieces."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folding = Folding()
        for frame in frames:
            rows = []
            for item, passage in zip(frame["item_id"], frame["passage"]):
                words = words_of(passage, folding)
                for at in range(0, max(len(words) - run + 1, 0), piece_words):
                    part = words[at : at + piece_words + run - 1]
                    rows.append((item, " ".join(part), len(part)))
            yield pd.DataFrame(rows, columns=["item_id", "words", "n"])

    known = items.select("item_id", "passage").filter("passage is not null and item_id is not null")
    return known.mapInPandas(fold, "item_id long, words string, n int")


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    """(doc_id, item_id) of every document whose `text` shares a run of at least `run` words with a passage.

    Texts are read whole, and stay where they are: the search shuffles nothing but its result. Passages are folded and
    cut on the executors and dealt to passes by hash, so that about `words_per_pass` words of them are on the driver at
    once; each pass builds its tables there, sends them (some 30 bytes a word) and reads the texts once. Null or shorter
    texts and passages share nothing; equal passages leak under each of their items; rows that repeat a document give
    its rows once. Other columns of both tables are not read.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long"
    known = cut(pieces(items, run).distinct())
    total = known.agg(F.sum("n")).first()[0] or 0
    passes = -(-total // words_per_pass)
    numbered = known.withColumn("pass", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(passes, 1))))
    found = None
    for k in range(passes):
        rows = numbered.filter(F.col("pass") == k).orderBy("item_id", "words").select("item_id", "words").collect()
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(Tables([(r[0], r[1]) for r in rows], run)))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tables, folding = pickle.loads(shared.value), Folding()
            for frame in frames:
                hits = list(tables.search([words_of(t, folding) for t in frame["text"]]))
                ids = frame["doc_id"].to_numpy()
                yield pd.DataFrame({"doc_id": [ids[i] for i, _ in hits], "item_id": [k for _, k in hits]}, dtype="int64")

        part = documents.select("doc_id", "text").filter("text is not null").mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found.distinct()
