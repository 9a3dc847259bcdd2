"""Token ids of whole texts by a public tokenizer file, inside Arrow tasks.

White space never lies inside a token of ``word_bpe_49k.json``: its normaliser turns each
run into one blank and its pre-tokenizer drops blanks. So the ids of a text are the ids
of its pieces between ASCII white space, one after the other, and each distinct piece
needs encoding once per worker. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import os
import struct

import numpy as np

from tilewright.llm.common import Cache, held
from tilewright.llm.prefix_table import PrefixTable

#: The tokenizer of the packing and counting queries.
DEFAULT_TOKENIZER = "word_bpe_49k.json"

#: Only these split at white space; the flag says that a piece encodes alone as in its text.
SPLITS_AT_SPACE = {"word_bpe_49k.json"}


#: Packers of as many ids as their place says.
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(33)]


def tokenizer_path(name: str) -> str:
    """Place of a tokenizer file: a path as it is, else a name the installed package knows."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        self.by_piece = os.path.basename(path) in SPLITS_AT_SPACE
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.plain = lambda text: model.encode(text, num_threads=1)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.model = model
            self.plain = lambda text: model.encode(text, add_special_tokens=False).ids
            self.many = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.path, self.prefixes = path, None
        self.cores = Cache(self._core, limit=116 << 20)
        self.pieces = Cache(self._piece, limit=112 << 20)

    def encode(self, text: str) -> bytes:
        return np.array(self.plain(text), dtype="<u4").tobytes()

    def _core(self, core: bytes) -> bytes:
        """Ids of one word, for tokenizers by piece. Words have few ids, which are packed faster than through an array."""
        ids = self.model.encode(core.decode(), add_special_tokens=False).ids
        return PACKERS[len(ids)](*ids) if len(ids) < len(PACKERS) else np.array(ids, dtype="<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """A lower-case core of letters and the marks behind it are tokens apart.

        Letters are judged as the normaliser leaves them: it turns some into a letter and a
        combining mark, which the pre-tokenizer joins with the marks behind.
        """
        core = piece.rstrip(b"!#$%&()*+,-./:;=?@[]^_{|}~")
        if core.isalpha():  # ASCII letters
            if len(core) == len(piece):
                return self.cores[core.lower()]
            return self.cores[core.lower()] + self.cores[piece[len(core) :]]
        marks = piece[len(core) :]
        if marks and core and self.model.normalizer.normalize_str(core.decode()).isalpha():
            return self.cores[core] + self.cores[marks]
        return self.cores[piece]

    def table(self) -> PrefixTable:
        """Counts of all beginnings of a piece, made when a worker first needs them."""
        if self.prefixes is None:
            self.prefixes = PrefixTable(self.path, self.model)
        return self.prefixes

    def of(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text."""
        if not self.by_piece:
            return self.encode(text.decode())
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def piece_lengths(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        """Pieces of the text and the number of ids of each."""
        pieces = text.split()
        return pieces, np.fromiter(map(len, map(self.pieces.__getitem__, pieces)), np.int64, len(pieces)) // 4


def ids_of(name: str) -> Ids:
    """One encoder per worker process, so its memo lasts over tasks."""
    return held(("ids", name), lambda: Ids(name))
