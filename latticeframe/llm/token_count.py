"""Token counts: count-only Viterbi over Aho-Corasick matches.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word, ordered by their ends; dynamic programming
carries the best score and that path's piece count to each end, and no backpointers. Words repeat, so each worker
keeps the counts of recent words in a table of bounded size.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from latticeframe.llm.common import slices
from latticeframe.llm.pieces import DEFAULT_MODEL, load

KEPT_WORDS = 300_000
KEPT_LENGTH = 40


class Counter:
    """Counts pieces and tokens: counts(word) is (pieces, tokens); an unknown character is one piece of several byte tokens."""

    def __init__(self, path: str):
        import ahocorasick

        self.pieces = load(path)
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in self.pieces.normal.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.kept: dict[str, tuple[int, int]] = {}

    def counts(self, word: str) -> tuple[int, int]:
        best, pieces, tokens = [0.0], [0], [0]
        alphabet, unknown = self.pieces.alphabet, self.pieces.unknown_score
        found = self.automaton.iter(word)
        at, match = next(found, (-1, None))
        for end, char in enumerate(word):
            top, p, t = float("-inf"), 0, 0
            while at == end:  # the longest match comes first, and an equal score does not replace it
                length, score = match
                start = end + 1 - length
                if best[start] + score > top:
                    top, p, t = best[start] + score, pieces[start] + 1, tokens[start] + 1
                at, match = next(found, (-1, None))
            if char not in alphabet and best[end] + unknown > top:
                top, p, t = best[end] + unknown, pieces[end] + 1, tokens[end] + (len(char.encode()) if self.pieces.byte_fallback else 1)
            best.append(top)
            pieces.append(p)
            tokens.append(t)
        return pieces[-1], tokens[-1]

    def text(self, text: str) -> tuple[int, int]:
        n_pieces = n_tokens = 0
        kept = self.kept
        for word in self.pieces.segments(text):
            got = kept.get(word)
            if got is None:
                got = self.counts(word)
                if len(word) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = got
            n_pieces += got[0]
            n_tokens += got[1]
        return n_pieces, n_tokens


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens long, n_pieces long), one for each row of docs, repeated rows included; no shuffle.

    A null or empty text has 0 tokens; a null id stays null. Other columns are not read, so their names cannot clash.
    Ties between segmentations go as pieces.py says. An empty table gives no rows. The file's scores are read as a
    unigram model's: counts of a file trained as byte pairs are not those of the library's merges.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        count = counter(model).text
        for part in slices(batches, 1):
            got = [count(t) if t else (0, 0) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.int64())], [id_col, "n_tokens", "n_pieces"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_pieces long")
