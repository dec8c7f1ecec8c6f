"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece encoded once.

A byte-level BPE splits a text into words before it merges, and always before a space that a
non-blank follows and between an ASCII letter and a mark. Cutting a text there doesn't change its
ids, so a block's pieces are deduplicated in Arrow and only pieces that the worker hasn't met go
through the tokenizer: those that begin with a space many at a time, told apart again by the bytes
that their tokens stand for.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; the longest piece it remembers, in bytes.
MEMORY, PIECE = 600_000, 64
#: First bytes of UTF-8 sequences that may be blanks beyond ASCII.
_UNSURE = np.zeros(256, bool)
_UNSURE[: 0x20 + 1] = True
_UNSURE[0x7F] = True
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
for _c in range(0x21, 0x7F):
    (_LETTER if chr(_c).isalpha() else _MARK)[_c] = not chr(_c).isdigit()
#: Pieces that go through the tokenizer as one text.
JOINED = 128


def default_path() -> str:
    """The vocabulary file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes blocks of texts with the vocabulary file at ``path``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # cutting is safe where words are split before merging and nothing rewrites or spans them
        pre = self.tokenizer.pre_tokenizer
        self.cuts = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.added = []
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.cuts &= not (token.lstrip or token.rstrip or token.single_word) and " " not in token.content
            self.added.append(token.content.encode())
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self._reset()

    def _reset(self) -> None:
        # the pieces that are remembered, and their places in starts and sizes
        self.known, self.places = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.used = self.count = 0

    def _forget(self) -> None:
        """Keeps the half of the memory that was met first, where frequent pieces are, if it is small enough."""
        count = min(self.count, MEMORY // 2)
        used = int(self.starts[count - 1] + self.sizes[count - 1]) if count else 0
        if used > 8 * MEMORY:
            self._reset()
            return
        kept = self.places < count
        self.known, self.places = self.known.filter(pa.array(kept)), self.places[kept]
        self.count, self.used = count, used

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The pieces' places in starts and sizes."""
        places = np.zeros(len(pieces), np.int64)
        spaced, others = [], []
        for i, p in enumerate(pieces):
            (spaced if self.cuts and p[0] == 0x20 and p[1:2] > b" " else others).append(i)
        if spaced:
            own = [pieces[i] for i in spaced]
            data = np.array([i for ids in self._ids([b"".join(own[k : k + JOINED]).decode("utf-8", "replace") for k in range(0, len(own), JOINED)]) for i in ids], np.uint32)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            reached = np.cumsum(self.bytes[data])
            stop = np.searchsorted(reached, ends, side="left") + 1
            if reached[-1] == ends[-1] and np.array_equal(reached[stop - 1], ends):
                places[spaced] = self._keep(data, np.diff(stop, prepend=0))
            else:  # bytes that aren't UTF-8
                others += spaced
        for k in range(0, len(others), 4096):
            got = self._ids([pieces[i].decode("utf-8", "replace") for i in others[k : k + 4096]])
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            places[others[k : k + 4096]] = self._keep(np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum())), sizes)
        return places

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.pool[self.used : self.used + len(ids)] = ids
        places = np.arange(self.count, self.count + len(sizes))
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.sizes[places] = sizes
        self.used += len(ids)
        self.count += len(sizes)
        return places

    def _places(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """Places of distinct pieces; those that the worker hasn't met are learnt."""
        found = pc.index_in(pieces, value_set=self.known)
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        places = np.append(self.places, 0)[found.fill_null(len(self.places)).to_numpy()]
        if len(missing):
            new = pieces.take(pa.array(missing))
            offsets = np.frombuffer(new.buffers()[1], np.int64)[new.offset : new.offset + len(new) + 1]
            raw, ends = new.buffers()[2].to_pybytes(), offsets.tolist()
            places[missing] = self._learn([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])
            short = np.diff(offsets) <= PIECE
            self.known = pa.concat_arrays([self.known, new.filter(pa.array(short))])
            self.places = np.append(self.places, places[missing][short])
        return places

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) as uint32, ``end`` after each text if given, and the texts' offsets."""
        if self.count > MEMORY or self.used > 16 * MEMORY:
            self._forget()
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low = int(offsets[0])
        offsets = offsets - low
        data = texts.buffers()[2].slice(low, int(offsets[-1])) if texts.buffers()[2] is not None else pa.py_buffer(b"")
        b = np.frombuffer(data, np.uint8)
        if self.cuts and len(b) > 1:
            inner = np.zeros(len(b) + 1, bool)
            inner[:-2] = (b[:-1] == 0x20) & ~_UNSURE[b[1:]]
            whole = data.to_pybytes()
            if not any(x in whole for x in self.added):
                inner[1:-1] |= _LETTER[b[:-1]] & _MARK[b[1:]]
            # a text's trailing space doesn't reach into the next text
            inner[np.clip(offsets[1:] - 1, 0, None)] = False
            inner[offsets] = True
            starts = np.flatnonzero(inner)
        else:
            starts = np.unique(offsets)
        starts = starts[starts < len(b)]
        if not len(starts):
            ids = np.full(len(texts) if end is not None else 0, end or 0, np.uint32)
            return ids, np.arange(len(texts) + 1) * (end is not None)
        bounds = np.append(starts, len(b))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), data])
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        at = self._places(coded.dictionary)[code]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        # ids before each text: those of the pieces that start before it
        before = np.append(0, ends)[np.searchsorted(starts, offsets)]
        if end is None:
            flat = self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
            return flat, before
        flat = np.empty(ends[-1] + len(texts), np.uint32)
        out = before + np.arange(len(texts) + 1)
        own = np.ones(len(flat), bool)
        own[out[1:] - 1] = False
        flat[own] = self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
        flat[out[1:] - 1] = end
        return flat, out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
