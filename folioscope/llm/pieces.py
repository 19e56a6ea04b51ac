"""The piece vocabulary shared by token counting and lattice sampling.

A SentencePiece model file gives pieces and scores; the scores are used as those of a unigram vocabulary. Spaces become the mark, one
is put in front, nothing else is normalised. No piece crosses from another character to the mark or holds a line feed, so a text falls
into units that are segmented by themselves.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Where the public tokenizers' files are; a parameter everywhere.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an unknown character's score lies below the lowest of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Characters from here on, but for the mark, are not told apart in looking for joins.
NEAR = 0x250

_UNITS = re.compile(r"▁+[^▁\n]*|\n|[^▁\n]+")


class Vocabulary:
    """Pieces by text with id and score; byte pieces by value."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.texts: list[bytes] = [b""] * model.vocab_size()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = float(model.get_score(i))
                self.texts[i] = piece.replace(MARK, " ").encode()
        self._joins()
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))

    def _joins(self) -> None:
        """Which characters some piece has side by side, for characters below NEAR and the mark; all others count as joined."""
        self._class = np.full(65536, NEAR + 1, np.int64)
        self._class[:NEAR], self._class[ord(MARK)] = np.arange(NEAR), NEAR
        self._joined = np.zeros((NEAR + 2, NEAR + 2), bool)
        for piece in self.ids:
            c = self._class[np.minimum(np.frombuffer(piece.encode("utf-32-le"), np.uint32), 65535)]
            self._joined[c[:-1], c[1:]] = True
        self._joined[NEAR + 1, :] = self._joined[:, NEAR + 1] = True

    def fine_units(self, text: str) -> list[str]:
        """The parts of a text between characters that no piece has side by side: the lattice is a chain of theirs."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        c = self._class[np.minimum(np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)]
        cuts = (np.flatnonzero(~self._joined[c[:-1], c[1:]]) + 1).tolist()
        return [marked[a:b] for a, b in zip([0, *cuts], [*cuts, len(marked)])]

    def decode(self, ids) -> str:
        """The text of piece ids: bytes of all pieces, the mark as a space, the first space taken off."""
        raw = b"".join(map(self.texts.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    return Vocabulary(path)


def units(text: str) -> list[str]:
    """The parts of a text that are segmented by themselves; none for an empty text."""
    return _UNITS.findall(MARK + text.replace(" ", MARK)) if text else []
