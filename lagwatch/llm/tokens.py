"""Token ids of whole texts inside tasks, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from lagwatch.llm.common import held

#: A run of marks between a letter and white space. It is a token run of its own either way,
#: and set apart it does not make another word of the one before it.
_MARKS = re.compile(r"(?<=[a-zß-öø-ÿ])([.,;:!?*#$%&|]+)(?= |$)")


class WordEncoder:
    """Encodes texts with a tokenizer that folds case and drops white space.

    The ids of a text are then those of its blank-separated pieces in a row, so each
    distinct piece is encoded once and remembered. ``remember`` bounds the pieces in memory: when
    half of them came since the last time, those not seen since then go. That costs time and
    changes no id.
    """

    def __init__(self, path: str, remember: int = 600_000, longest: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.remember, self.longest = remember, longest
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        text = text.replace("\n", " ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")  # letters whose folding depends on their neighbours stay as they are
        return _MARKS.sub(r" \1", text.lower()).split(" ")

    def _ids(self, pieces: list[str]) -> Iterator[bytes]:
        for start in range(0, len(pieces), 10_000):
            for e in self.tokenizer.encode_batch(pieces[start:start + 10_000], add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes()

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Remember the ids of the missing pieces; return those of pieces too long, or too many, to keep."""
        most = self.remember // 2
        if len(self.recent) + len(missing) > most:
            self.older, self.recent = self.recent, {}
        once, new = {}, []
        for piece in missing:
            if piece in self.older:
                (self.recent if len(self.recent) < most else once)[piece] = self.older[piece]
            else:
                new.append(piece)
        for piece, ids in zip(new, self._ids(new), strict=True):
            (self.recent if len(piece) <= self.longest and len(self.recent) < most else once)[piece] = ids
        return once

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; the unknown pieces of all of them are encoded together."""
        pieces = [self.pieces(t) if t else [] for t in texts]
        found = [list(map(self.recent.get, p)) for p in pieces]
        gaps = [_gaps(f) for f in found]
        missing = {p[i] for p, g in zip(pieces, gaps, strict=True) for i in g}
        if missing:
            once = self._learn(missing)
            for p, f, g in zip(pieces, found, gaps, strict=True):
                for i in g:
                    ids = self.recent.get(p[i])
                    f[i] = once[p[i]] if ids is None else ids
        return [np.frombuffer(b"".join(f), self.kind) for f in found]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


def _gaps(found: list[bytes | None]) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return held(("tokens", path), lambda: WordEncoder(path))


def encoded(path: str, texts: Iterable[str | None], end_id: int) -> Iterator[np.ndarray]:
    """Ids of each text as unsigned 32-bit integers, with the end id."""
    use = encoder(path)
    for group in _groups(texts):
        for ids in use.encode_many(group):
            out = np.empty(len(ids) + 1, "<u4")
            out[:-1], out[-1] = ids, end_id
            yield out


def _groups(texts: Iterable[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    """Texts in order, some ``chars`` characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "") + 100
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group
