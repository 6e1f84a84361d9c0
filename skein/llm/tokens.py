"""Token ids at the speed of a dictionary: pre-token chunks are encoded once by `tokenizers` and then looked up."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from skein.llm.common import CACHES

#: A single space between two characters that are not white space always starts a new pre-token, so a text may be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Whether some single space is at an end of the text or beside other white space.
_RUN = re.compile(r" (?:\s|\Z|(?<=\s )|(?<=\A ))")

#: Characters of texts whose new chunks are learned together; a longer text is a group of its own.
GROUP_CHARS = 500_000


def chunks(text: str) -> list[str]:
    """Pieces of the text without the single spaces that part them; every piece but the first is encoded with its leading space."""
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes. Chunks are cached in two generations of
    `most` entries: when the younger is full it becomes the older, and what is used again moves back."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        by_id = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        #: Whether the token of an id starts with a space (a byte-level vocabulary writes it so).
        self.starts = np.array([by_id.get(i, "").startswith("\u0120") for i in range(max(by_id) + 1)])
        self.most, self.first, self.later, self.older = most, {}, {}, {}

    def _learn(self, cache: dict, missing: list[str], lead: str) -> None:
        older = self.older if cache is self.later else {}
        cache.update((m, older[m]) for m in missing if m in older)
        missing = [m for m in missing if m not in cache]
        for at in range(0, len(missing), 5000):
            cache.update(self._encoded(missing[at : at + 5000], lead))

    def _encoded(self, part: list[str], lead: str) -> dict[str, bytes]:
        """Ids of each chunk. Chunks without white space that have a leading space are encoded as one text: there every id whose
        token starts with a space starts a chunk."""
        plain = [m for m in part if len(m.split()) == 1] if lead == " " else []
        out: dict[str, bytes] = {}
        if plain:
            ids = np.asarray(self.tok.encode_batch_fast([lead + lead.join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(plain):
                raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                out = {m: raw[a:b] for m, a, b in zip(plain, [0, *ends[:-1]], ends, strict=True)}
        rest = [m for m in part if m not in out]
        for m, e in zip(rest, self.tok.encode_batch([lead + m for m in rest], add_special_tokens=False), strict=True):
            out[m] = np.asarray(e.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text counts as empty."""
        if len(self.later) > self.most:
            self.later, self.older = {}, self.later
        if len(self.first) > self.most // 10:
            self.first.clear()
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append(chunks(text) if text else [])
            held += len(text or "")
            if held >= GROUP_CHARS:
                out += self._joined(group)
                group, held = [], 0
        return out + self._joined(group)

    def _joined(self, group: list[list[str]]) -> list[bytes]:
        """Ids of texts given as chunks. What none of them has seen is learned in one call, as a call costs as much as dozens of chunks."""
        heads, rests = {g[0] for g in group if g}, set()
        for g in group:
            rests.update(g[1:])
        for cache, seen, lead in ((self.first, heads, ""), (self.later, rests, " ")):
            if missing := seen.difference(cache):
                self._learn(cache, list(missing), lead)
        later = self.later.__getitem__
        return [self.first[g[0]] + b"".join(map(later, g[1:])) if g else b"" for g in group]


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker and vocabulary."""
    return ChunkEncoder(path)


CACHES["tokens"] = encoder.cache_clear
