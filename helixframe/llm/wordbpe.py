"""Batch encoder for a lower-casing word-level BPE file, equal to the ``tokenizers`` library's ids.

Texts are lower-cased and split into runs of letters, single digits and runs of other
characters, all in numpy on the UTF-8 bytes; each distinct piece of a batch is merged once, all pieces
side by side.  What the byte tables do not cover (an apostrophe, characters outside
U+0000-U+07FF, marks, signs whose lower case or normal form differs in length, very long pieces, strings of added
tokens such as ``<|endoftext|>``, which have ids of their own) goes through the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa

from helixframe.llm.textbytes import padded, span_hash, utf8

SPACE, LETTER, DIGIT, OTHER, HARD = range(5)
LONGEST = 48
#: Distinct pieces whose ids are kept from slice to slice, about 40 bytes each.
REMEMBERED = 1 << 17
_NEVER = np.int32(2**31 - 1)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        # Lower-cased, as texts are when they are searched; the library finds what exactly matches.
        self.added = [t["content"].lower().encode() for t in whole.get("added_tokens") or []]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pair = np.fromiter((vocab[a] << 20 | vocab[b] for a, b in merges), np.int64, len(merges))
        order = np.argsort(pair)
        self.pair, self.rank = pair[order], order.astype(np.int32)
        self.merged = np.fromiter((vocab[a + b] for a, b in merges), np.int32, len(merges))
        self._tables()
        self._forget()

    @cached_property
    def library(self):
        """The library's tokenizer, loaded when a first text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _tables(self) -> None:
        self.low1 = np.arange(256, dtype=np.uint8)
        self.low1[65:91] += 32
        self.kind1 = np.full(256, OTHER, np.uint8)
        self.kind1[[9, 10, 11, 12, 13, 32]] = SPACE
        self.kind1[97:123] = LETTER
        self.kind1[65:91] = LETTER
        self.kind1[48:58] = DIGIT
        self.kind1[39] = HARD
        self.kind1[128:] = HARD
        self.low2, self.kind2 = np.arange(2048, dtype=np.uint16), np.full(2048, HARD, np.uint8)
        for code in range(128, 2048):
            char = chr(code)
            low, group = char.lower(), unicodedata.category(char)[0]
            if len(low) == 1 and 128 <= ord(low) < 2048 and all(unicodedata.normalize("NFC", c) == c for c in (char, low)):
                if group == "L":
                    self.low2[code], self.kind2[code] = ord(low), LETTER
                elif group in "PS" and low == char:
                    self.kind2[code] = OTHER

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin."""
        data, at = utf8(texts)
        n = len(at) - 1
        data, kind = self._classes(data)
        hard = np.zeros(n, bool)
        bad = np.flatnonzero(kind == HARD)
        hard[np.searchsorted(at, bad, "right") - 1] = True
        hard[np.searchsorted(at, self._added_at(data), "right") - 1] = True
        starts, ends, first = self._pieces(data, kind, at, hard)
        ids, begin = self._merge_all(data, starts, ends)
        text_at = begin[first]
        if not hard.any():
            return ids, text_at
        parts = [ids[a:b] for a, b in zip(text_at[:-1], text_at[1:])]
        for k in np.flatnonzero(hard):
            parts[k] = np.array(self.library.encode(texts[int(k)].as_py() or "", add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _added_at(self, data: np.ndarray) -> list[int]:
        """Where an added token's string begins, in any case; one across two texts is harmless."""
        raw, found = data.tobytes(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
        return found

    def _classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, low = self.kind1[data], self.low1[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        if len(lead):
            code = ((data[lead] & 0x1F).astype(np.uint16) << 6) | (data[lead + 1] & 0x3F)
            to = self.low2[code]
            kind[lead] = kind[lead + 1] = self.kind2[code]
            low[lead], low[lead + 1] = 0xC0 | (to >> 6).astype(np.uint8), 0x80 | (to & 0x3F).astype(np.uint8)
        return low, kind

    def _pieces(self, data: np.ndarray, kind: np.ndarray, at: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.empty(len(kind) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edge[at] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        good = kind[starts] != SPACE
        if hard.any():
            good &= ~hard[np.searchsorted(at, starts, "right") - 1]
        starts, ends = starts[good], ends[good]
        return starts, ends, np.searchsorted(starts, at)

    def _merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        length = ends - starts
        found = span_hash(padded(data), starts, length)
        order = np.argsort(found)
        found = found[order]
        new = np.empty(len(found), bool)
        new[0], new[1:] = True, found[1:] != found[:-1]
        where = order[new]
        code = np.empty(len(order), np.int32)
        code[order] = np.cumsum(new, dtype=np.int32) - 1
        keys = found[new]
        del found, order, new
        at = self._known(data, keys, starts[where], length[where])
        count, origin, pool = self.counts[at], self.origins[at], self.pool
        each = count[code]
        begin = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat((origin[code] - begin[:-1]).astype(np.int32), each)
        source += np.arange(begin[-1], dtype=np.int32)
        return pool[source], begin

    def _known(self, data: np.ndarray, keys: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the distinct pieces in the table of pieces already merged; new ones are merged and join it.

        Slices share most of their words.  The table starts anew beyond ``REMEMBERED`` pieces.
        """
        if len(self.keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == keys[old]
        fresh = np.flatnonzero(~old)
        if not len(fresh):
            return at
        first, size = first[fresh], size[fresh]
        chunk: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, counts, ids
        lower = 0
        for upper in (2, 4, 6, 8, 12, 16, 24, LONGEST):
            pick = np.flatnonzero((size > lower) & (size <= upper))
            if len(pick):
                chunk.append((pick, *self._merge(data, first[pick], size[pick], upper)))
            lower = upper
        for k in np.flatnonzero(size > LONGEST):
            got = self.library.encode(data[first[k] : first[k] + size[k]].tobytes().decode(), add_special_tokens=False).ids
            chunk.append((np.array([k]), np.array([len(got)]), np.array(got, np.int32)))
        piece = np.concatenate([c[0] for c in chunk])
        number = np.concatenate([c[1] for c in chunk])
        origin = len(self.pool) + np.cumsum(number) - number
        order = np.argsort(np.concatenate([self.keys, keys[fresh][piece]]), kind="stable")
        self.counts = np.concatenate([self.counts, number.astype(np.int32)])[order]
        self.origins = np.concatenate([self.origins, origin])[order]
        self.pool = np.concatenate([self.pool, *(c[2] for c in chunk)])
        self.keys = np.concatenate([self.keys, keys[fresh][piece]])[order]
        return np.searchsorted(self.keys, keys)

    def _forget(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.origins, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right.astype(np.int64)
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.rank[at], _NEVER)

    def _merge(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, a row of symbols each, -1 after the end."""
        n, col = len(first), np.arange(width)
        inside = col < size[:, None]
        byte = data[np.minimum(first[:, None] + col, len(data) - 1)]
        symbol = np.where(inside, self.inner[byte], np.int32(-1))
        symbol[np.arange(n), size - 1] = self.final[byte[np.arange(n), size - 1]]
        done = np.full((n, width), -1, np.int32)
        row = np.arange(n)
        rank = self._ranks(symbol[:, :-1], symbol[:, 1:])
        while len(row):
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(row)), best]
            live = value < _NEVER
            if not live.all():
                done[row[~live]] = symbol[~live]
                row, symbol, rank, best, value = row[live], symbol[live], rank[live], best[live], value[live]
                if not len(row):
                    break
            here = np.arange(len(row))
            shift = np.minimum(col + (col > best[:, None]), width - 1)
            last = symbol.shape[1] - 1
            symbol = np.take_along_axis(symbol, shift, 1)
            symbol[:, last] = -1
            symbol[here, best] = self.merged[value]
            rank = np.take_along_axis(rank, shift[:, : width - 1].clip(max=width - 2), 1)
            rank[:, -1] = _NEVER
            right = np.minimum(best + 1, last)
            after = np.where(best < last, symbol[here, right], -1)
            ok = best < width - 1
            rank[here[ok], best[ok]] = self._ranks(symbol[here, best], after)[ok]
            before = best > 0
            rank[here[before], best[before] - 1] = self._ranks(symbol[here[before], best[before] - 1], symbol[here[before], best[before]])
        count = (done >= 0).sum(axis=1)
        return count, done[done >= 0]
