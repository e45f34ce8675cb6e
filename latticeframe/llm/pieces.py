"""A SentencePiece vocabulary file read as a unigram vocabulary: pieces, scores and tie rules.

Pieces and scores are taken from the file as they stand. The best segmentation of a text is the one with the highest
sum of scores; among equal sums the piece that starts earliest (the longest one) wins at each end, as in the
sentencepiece library's unigram encoder. Scores are summed in double precision, where the vocabulary's scores add
up exactly, so that a word's pieces do not depend on rounding left over from the words before it.
"""

from __future__ import annotations

import re
from functools import lru_cache

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.surface = [model.id_to_piece(i) for i in ids]
        self.unknown = model.unk_id()
        self.control = {i for i in ids if model.is_control(i)}
        self.byte_ids = [-1] * 256
        self.byte_of = {}
        self.normal: dict[str, tuple[int, float]] = {}
        for i in ids:
            if model.is_byte(i):
                self.byte_of[i] = value = int(self.surface[i][3:5], 16)
                self.byte_ids[value] = i
            elif not (i in self.control or model.is_unknown(i) or model.is_unused(i)):
                self.normal[self.surface[i]] = (i, float(model.get_score(i)))
        self.byte_fallback = -1 not in self.byte_ids
        self.unknown_score = min(score for _, score in self.normal.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.normal))
        self.alphabet = {p for p in self.normal if len(p) == 1}
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.normal)
        self.segment = re.compile(r"[\s\S]+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def segments(self, text: str) -> list[str]:
        """Stretches of the escaped text that no piece crosses: each starts with the spaces before its word."""
        return self.segment(SPACE + text.replace(" ", SPACE)) if text else []

    def unknown_ids(self, char: str) -> list[int]:
        """Ids for a character that no piece covers: its UTF-8 bytes, or the unknown id in a vocabulary without bytes."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_fallback else [self.unknown]


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The vocabulary at path, read once a process. The file must be at the same path on every executor."""
    return Pieces(path)
