"""Counts of unigram tokens, without the tokens.

A vocabulary of scored pieces is held in an Aho-Corasick automaton, which lists every piece that ends at a character;
Viterbi's recurrence keeps, for each character, the best score so far and the number of pieces on that path. As in the
tokenizers library: a candidate replaces another only if its score is greater and candidates come by ascending start, so
that of equal paths the one with the longer last piece stays; a character that is no piece of its own may be unknown, at
ten below the least score; unknown characters fall back to their bytes, a token each.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Marks and what follows them.
RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: What an unknown character costs below the least score of the vocabulary (fixed by the tokenizer).
UNKNOWN = 10.0
#: Words that a worker remembers.
REMEMBERED = 1_000_000


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.auto.add_word(piece, (len(piece), float(score)))
        self.auto.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.bytes_known = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        # No piece goes from another character into a mark, so that no path crosses such a place and texts may be cut there.
        self.cuts = SPACE in self.single and not any(p[i] == SPACE != p[i - 1] for p, _ in pieces for i in range(1, len(p)))
        self.count: dict[str, int] = {}
        self.score: dict[str, float] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path over one piece of text."""
        size = len(word)
        score: list[float | None] = [None] * (size + 1)
        count = [0] * (size + 1)
        fresh = [False] * (size + 1)  # the last piece of the path is unknown
        score[0] = 0.0
        found = iter(self.auto.iter(word))
        nxt = next(found, None)
        for end in range(1, size + 1):
            best, n, unk = None, 0, False
            while nxt is not None and nxt[0] == end - 1:  # longest first
                k, s = nxt[1]
                s += score[end - k]
                if best is None or s > best:
                    best, n, unk = s, count[end - k] + 1, False
                nxt = next(found, None)
            if word[end - 1] not in self.single:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    best, unk = s, True
                    if self.bytes_known:
                        n = count[end - 1] + len(word[end - 1].encode())
                    else:
                        n = count[end - 1] + (not fresh[end - 1])  # unknowns in a row are one token
            score[end], count[end], fresh[end] = best, n, unk
        return count[size], score[size]

    def text(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a whole text: spaces become marks, and a text begins with one."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        if not self.cuts:
            return self.word(text)
        words = RUNS.findall(text) if SPACE * 2 in text else [SPACE + w for w in text[1:].split(SPACE)]
        count, score = self.count, self.score
        new = {w for w in words if w not in count}
        if new:
            if len(count) + len(new) > REMEMBERED:
                count.clear()
                score.clear()
                new = set(words)
            for w in new:
                count[w], score[w] = self.word(w)
        return sum(map(count.__getitem__, words)), sum(map(score.__getitem__, words))


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    """One counter for each worker process and vocabulary."""
    return Counter(read_pieces(path))


def unigram_counts(text: Column, path: str) -> Column:
    """struct<n_tokens: long, score: double> of whole texts; 0 and 0 for null and empty ones."""

    @F.arrow_udf("n_tokens long, score double")
    def counted(texts: pa.Array) -> pa.Array:
        c = counter(path)
        got = [c.text(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["n_tokens", "score"])

    return counted(text.cast("string"))


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `n_tokens` and `score` (of the best segmentation), which replace columns of these names.

    Every row is counted on its own: repeated rows alike, rows with a null id like others; an empty table stays empty.
    """
    return docs.withColumn("_counted", unigram_counts(F.col(text), path)).withColumns({"n_tokens": F.col("_counted.n_tokens"), "score": F.col("_counted.score")}).drop("_counted")
