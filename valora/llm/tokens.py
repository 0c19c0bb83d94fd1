"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library, inside Python tasks."""

from __future__ import annotations

import os
from itertools import islice

import numpy as np

WIDE, NARROW = np.dtype("<u4"), np.dtype("<u2")
_ENCODERS: dict[str, "ChunkEncoder"] = {}


def encoder(path: str, cache_rows: int = 1_200_000) -> "ChunkEncoder":
    """One per worker process and file; its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, cache_rows)
    return _ENCODERS[path]


def forget() -> None:
    """Drop the encoders of this worker process: stages that do not encode run in workers that did, and need the memory."""
    _ENCODERS.clear()


class ChunkEncoder:
    """Encodes texts cut at blanks, each distinct chunk once, as the library does by default.

    The vocabulary's splitting pattern always cuts before a blank that stands between two characters that
    are no white space, or before one that is followed by one: the ids of a text are those of its chunks
    in a row. Texts with a blank before white space, and texts that hold the string of an added token, are
    encoded whole. About ``cache_rows`` chunks are remembered, in ids of 16 bits where the vocabulary allows.
    """

    def __init__(self, path: str, cache_rows: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_rows = cache_rows
        self.known: dict[str, bytes | None] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # the byte-level name of a blank
        self.kind = NARROW if len(self.opens) <= 1 << 16 else WIDE
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def _learn(self, chunks: list[str]) -> None:
        odd = [c for c in chunks if not c or c[0].isspace()]
        self.known.update(dict.fromkeys(odd))
        good = [c for c in chunks if c and not c[0].isspace()]
        groups = [good[i:i + 1000] for i in range(0, len(good), 1000)]
        found = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found):
            ids = np.array(e.ids, dtype=self.kind)
            cuts = np.append(np.nonzero(self.opens[ids])[0], len(ids)).tolist()
            if len(cuts) != len(group) + 1 or cuts[0]:
                self.known.update(zip(group, self._whole([" " + c for c in group])))
                continue
            raw, size = ids.tobytes(), ids.itemsize
            self.known.update((c, raw[size * i:size * j]) for c, i, j in zip(group, cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return [np.frombuffer(x, dtype=self.kind).astype(WIDE).tobytes() for x in self.encode_short(texts)]

    def encode_short(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as integers of type ``kind``."""
        return [x for i in range(0, len(texts), 256) for x in self._encode(texts[i:i + 256])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") for t in texts]
        heads = self._whole([p[0] for p in parts])
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not any(a in t for a in self.added)]
        todo = self._join(heads, parts, plain, out)
        if todo:
            wanted = set().union(*(parts[i][1:] for i in todo))
            new = [c for c in wanted if c not in self.known]
            if len(self.known) + len(new) > self.cache_rows:
                # Frequent chunks come early: the older half stays.
                self.known = dict(islice(self.known.items(), self.cache_rows // 2))
                new = [c for c in wanted if c not in self.known]
            self._learn(new)
            self._join(heads, parts, todo, out)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._whole([texts[i] for i in rest])):
            out[i] = x
        return out

    def _join(self, heads, parts, rows, out) -> list[int]:
        """Fill ``out`` where all chunks are known; the rows with unknown ones."""
        unknown, get = [], self.known.__getitem__
        for i in rows:
            try:
                out[i] = heads[i] + b"".join(map(get, parts[i][1:]))
            except KeyError:
                unknown.append(i)
            except TypeError:  # a chunk that depends on its neighbours
                pass
        return unknown
