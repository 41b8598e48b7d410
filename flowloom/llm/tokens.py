"""Token ids of whole texts, by the tokenizers library, one chunk at a time.

Most words of a corpus are frequent, so each worker remembers the ids of the chunks it has
seen.  A text is cut only where the tokenizer itself always splits:

* a tokenizer that drops white space and tokenizes words alone: at white space;
* a byte-level one with the usual pattern: before a blank next to a solid character;
* both: between an ASCII letter and a sign, in either order (but not after an apostrophe).

Other tokenizers encode whole texts.  Cutting, telling chunks apart and putting ids together
work on whole Arrow columns; only distinct chunks become Python objects.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from flowloom.llm.common import worker_cache
from flowloom.llm.words import _LOWER, Block, blocks

MOST_CHUNKS, MOST_BYTES = 500_000, 32 << 20  # remembered by a worker
TEXT_BLOCK = 2 << 20
CHUNKS_AT_ONCE = 1 << 19

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
# First bytes of characters that cannot be white space; those from C2, E1, E2 and E3 can.
_STARTS_SOLID = _SOLID.copy()
_STARTS_SOLID[0xC3:0xF5] = True
_STARTS_SOLID[[0xE1, 0xE2, 0xE3]] = False
_OTHER, _LETTER, _SIGN, _DIGIT, _BLANK = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK


def vocabulary_path(name: str) -> str:
    """Where the public tokenizer file of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_mode(config: dict) -> str:
    """Where texts may be cut: at "words", by "bytes" rules, or not ("whole")."""
    before, split = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in config.get("added_tokens", [])):
        return "whole"
    if before is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
        return "bytes"
    steps = split.get("pretokenizers") or [{}]
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    kinds = {x.get("type") for x in (before or {}).get("normalizers", [])}
    if drops and kinds <= {"NFC", "Replace", "Lowercase"} and "\\s\\p{L}\\p{N}" in json.dumps(steps[0]).replace("\\\\", "\\"):
        return "words"
    return "whole"


def _signs(data: np.ndarray, mode: str) -> np.ndarray:
    """Cuts inside words: the places of the second of two bytes that never share a token."""
    kind = _KIND[data]
    one, two = kind[:-1], kind[1:]
    apart = (one == _LETTER) & ((two == _SIGN) | (two == _DIGIT)) | (two == _LETTER) & (one == _SIGN) & (data[:-1] != 39)
    if mode == "words":
        apart |= (one == _DIGIT) & (two == _DIGIT)
    else:
        apart |= (one == _LETTER) & (two == _BLANK)
    return np.flatnonzero(apart) + 1


def _places(n: int, *parts: np.ndarray) -> np.ndarray:
    """All numbers up to ``n`` that occur in ``parts``, in order."""
    found = np.zeros(n + 1, bool)
    for part in parts:
        found[part] = True
    return np.flatnonzero(found)


def cut_chunks(block: Block, mode: str, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where chunks begin and the end, where rows begin and the end) of a block.

    Rows never share a chunk.  ``fine`` also cuts inside words, and in mode "words" folds A-Z
    (except before a sign that may join the letter), which no such tokenizer tells apart.
    """
    data, rows = block.data, np.append(block.starts, len(block.data))
    if mode == "words":
        keep = _KIND[data] != _BLANK
        before = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(keep, out=before[1:])
        if fine:
            alone = np.append(data[1:] < 128, True)
            data = np.where(alone, _LOWER[data], data)
        cut = before[np.flatnonzero(~keep)]
        inner = before[_signs(data, mode)] if fine else cut
        data, rows = data[keep], before[rows]
        return data, _places(len(data), cut, inner, rows), rows
    if mode == "bytes":
        blank = np.flatnonzero(data[1:-1] == 32) + 1
        cut = blank[_SOLID[data[blank - 1]] | _STARTS_SOLID[data[blank + 1]]]
        inner = _signs(data, mode) if fine else cut
        return data, _places(len(data), cut, inner, rows), rows
    return data, _places(len(data), rows), rows


def distinct_chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(the distinct ones of some chunks as bytes, which of them each chunk is)."""
    for at in range(0, len(offsets) - 1, CHUNKS_AT_ONCE):
        own = np.ascontiguousarray(offsets[at : at + CHUNKS_AT_ONCE + 1])
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(own), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``lengths`` of them, one after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def _room(values: np.ndarray, count: int) -> np.ndarray:
    """``values`` with room for ``count`` of them."""
    return values if count <= len(values) else np.resize(values, 2 * count)


class WordEncoder:
    """Ids of texts.

    ``ordinary`` takes the names of special tokens in a text for ordinary text; otherwise
    they are the special tokens, as the library has it by default.
    """

    def __init__(self, path: str, ordinary: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = ordinary
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.mode = split_mode(config)
        self.special = [] if ordinary else [t["content"].lower().encode() for t in config.get("added_tokens", [])]
        # Tokens that begin (bytes) or end (words) a word of letters.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = config["model"].get("end_of_word_suffix")
        if self.mode == "words" and not suffix:
            self.mode = "whole"
        for token, number in self.tokenizer.get_vocab().items():
            self.edge[number] = token.startswith("\u0120") if self.mode == "bytes" else token.endswith(suffix or "\0")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used, self.held = np.empty(1 << 16, np.uint32), 0, 0
        self.start, self.size = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def cut_mode(self, block: Block) -> tuple[str, bool]:
        """How to cut a block; one that names a special token is cut with care."""
        if self.special:
            text = block.data.tobytes().lower()
            if any(s in text for s in self.special):
                return ("whole" if self.mode == "bytes" else self.mode), False
        return self.mode, True

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters, by one call; None if their tokens don't tell the words apart."""
        lead = "" if self.mode == "bytes" else " "  # in bytes mode they begin with a blank
        ids = np.array(self.tokenizer.encode_batch_fast([lead.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return None
        return ids, np.diff(edges, append=len(ids)) if self.mode == "bytes" else np.diff(edges, prepend=-1)

    def _encoded(self, chunks: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has; ``plain`` ones are words of letters."""
        found = self._together(chunks) if plain else None
        if found is None:
            coded = [c.ids for c in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            found = np.array([i for ids in coded for i in ids], np.uint32), np.array([len(ids) for ids in coded], np.int64)
        return found

    def _encode_chunks(self, chunks: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(places of some chunks in the list, their ids, how many each has), until all are done."""
        texts = [c.decode() for c in chunks]
        if self.mode == "whole":
            plain = [False] * len(texts)
        elif self.mode == "words":
            plain = [t.isalpha() and t.lower().isalpha() for t in texts]
        else:
            plain = [t[:1] == " " and t[1:].isalpha() for t in texts]
        for wanted in (True, False):
            own = [i for i, p in enumerate(plain) if p is wanted]
            for at in range(0, len(own), 5_000):
                some = own[at : at + 5_000]
                yield some, *self._encoded([texts[i] for i in some], wanted)

    def sizes(self, chunks: list[bytes]) -> np.ndarray:
        """How many ids each chunk has; nothing is remembered."""
        out = np.zeros(len(chunks), np.int64)
        for some, _, size in self._encode_chunks(chunks):
            out[some] = size
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        for some, ids, size in self._encode_chunks(chunks):
            self._keep([chunks[i] for i in some], ids, size)

    def _keep(self, chunks: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        first, last, upto = len(self.known), len(self.known) + len(chunks), self.used + len(ids)
        self.known.update(zip(chunks, range(first, last), strict=True))
        self.held += sum(map(len, chunks))
        self.start, self.size, self.pool = _room(self.start, last), _room(self.size, last), _room(self.pool, upto)
        self.size[first:last] = size
        self.start[first:last] = self.used + np.cumsum(size) - size
        self.pool[self.used : upto] = ids
        self.used = upto

    def slots(self, chunks: pa.Array) -> np.ndarray:
        """Where the ids of each chunk lie: an index into ``start`` and ``size``."""
        distinct = chunks.to_pylist()
        if len(self.known) + len(distinct) > MOST_CHUNKS or self.held > MOST_BYTES:
            self._forget()
        found = list(map(self.known.get, distinct))
        new = [i for i, slot in enumerate(found) if slot is None]
        if new:
            self._learn([distinct[i] for i in new])
            for i in new:
                found[i] = self.known[distinct[i]]
        return np.array(found, np.int64)

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some rows after the other: (rows, all their ids, where each row's ids begin and the end)."""
        for block in blocks(texts, block_bytes=TEXT_BLOCK):
            data, offsets, rows = cut_chunks(block, *self.cut_mode(block))
            ids, size = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
            for distinct, which in distinct_chunks(data, offsets):
                slot = self.slots(distinct)[which]
                size.append(self.size[slot])
                ids.append(self.pool[spread(self.start[slot], size[-1])])
            total = np.cumsum(np.concatenate(size))
            yield block.rows, np.concatenate(ids), total[np.searchsorted(offsets, rows)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        out = []
        for _, ids, first in self.encode_column(pa.array(texts, pa.string())):
            ids = ids.astype("<u4")
            out += [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return out


def encoder(path: str, ordinary: bool = True) -> WordEncoder:
    """The worker's encoder for this file."""
    cache = worker_cache("encoders")
    if (path, ordinary) not in cache:
        cache[path, ordinary] = WordEncoder(path, ordinary)
    return cache[path, ordinary]
