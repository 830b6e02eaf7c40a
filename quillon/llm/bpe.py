"""Tokenizer files of the ``tokenizers`` library, applied to whole columns.

The library is called once per distinct pre-token instead of once per occurrence. Texts are cut into the file's own
pre-tokens with vector operations, for ASCII runs without apostrophes; any other run between ASCII white space goes to the
library as a whole, which its rules allow because no pre-token reaches over such white space. Distinct pre-tokens are
found by 64-bit hash and kept, with their bytes and ids, in a table of bounded size in the Python worker; every occurrence
is compared with the table's bytes, so a hash that two of them share costs time and not a wrong id.

The ids are those of the library's plain call, in which a special token's own string in a text is that token; texts that
hold one go to the library whole. With ``special=False`` such strings are text like any other.

Defined results: null counts as empty text and has no ids; equal texts have equal ids; a text of any length is read in
blocks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm.textkit import SPACE, blocks, raw, run_hashes

#: Distinct pre-tokens a worker remembers.
REMEMBERED = 1_500_000

_CLASS = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other, 4 not decided here
_CLASS[SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[39] = 4
_CLASS[128:] = 4
#: White space beyond ASCII: next to ASCII white space it would join one pre-token with it.
_WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256 up."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else n))
        n += b not in keep
    return out


_LETTERS = str.maketrans(dict(enumerate(_byte_letters())))


class Bpe:
    """One tokenizer file; ``encode`` gives the ids of every text of a column, without special tokens."""

    _open: dict[tuple[str, bool], Bpe] = {}

    @classmethod
    def of(cls, path: str, special: bool = True) -> Bpe:
        if (path, special) not in cls._open:
            cls._open[path, special] = cls(path, special)
        return cls._open[path, special]

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        self.model = self.tok.model
        added = spec.get("added_tokens") or []
        if not special and not all(t.get("special") for t in added):
            raise ValueError("added tokens that are not special are never text like any other")
        self.whole_if = [t["content"] for t in added] if special else []
        pre = spec.get("pre_tokenizer") or {}
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.style = "byte"
        elif pre.get("type") == "Sequence" and steps == ["NFC", "Replace", "Lowercase"]:
            self.style = "word"
        else:
            raise ValueError("neither a byte-level nor a lower-case word-end tokenizer file")
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # of each known pre-token its first id and the number of its ids
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.body_at = np.zeros(0, np.int64)  # and its first byte and the number of its bytes
        self.body_size = np.zeros(0, np.int64)
        self.body = np.zeros(0, np.uint8)

    def _bounds(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of a block, and which of them the library must cut itself."""
        cls = _CLASS[data]
        ink = cls != 0
        fresh = np.zeros(len(data), bool)  # a document begins here
        fresh[0] = True
        fresh[cuts[(cuts > 0) & (cuts < len(data))]] = True
        before = np.zeros(len(data), bool)  # the byte before, of the same document, is not white space
        before[1:] = ink[:-1]
        before &= ~fresh
        change = np.ones(len(data), bool)
        np.not_equal(cls[1:], cls[:-1], out=change[1:])
        change |= fresh
        if self.style == "word":
            change |= cls == 2
        run = ink & ~before
        odd = cls == 4
        if odd.any():
            run_at = np.flatnonzero(run)
            flagged = np.logical_or.reduceat(odd, run_at)  # white space between runs is never odd
            inside = np.flatnonzero(ink)
            in_odd = np.zeros(len(data), bool)
            in_odd[inside] = flagged[np.cumsum(run)[inside] - 1]
            change &= ~in_odd | run
        else:
            in_odd = odd
        if self.style == "word":
            begin = ink & change
            stop = ink.copy()
            stop[:-1] = ink[:-1] & (begin[1:] | ~ink[1:] | fresh[1:])
            starts = np.flatnonzero(begin)
            return starts, np.flatnonzero(stop) + 1, in_odd[starts]
        after = np.zeros(len(data), bool)  # the byte after, of the same document, is not white space
        after[:-1] = ink[1:] & ~fresh[1:]
        spaced = np.zeros(len(data), bool)  # the byte before, of the same document, is a blank
        spaced[1:] = data[:-1] == 32
        spaced &= ~fresh
        begin = (ink & change & ~spaced) | (~ink & (before | fresh | after))
        starts = np.flatnonzero(begin)
        odd_here = in_odd[starts]
        blank = ~ink[starts]
        follow = np.minimum(starts + 1, len(data) - 1)
        odd_here |= blank & (data[starts] == 32) & after[starts] & in_odd[follow]
        return starts, np.append(starts[1:], len(data)), odd_here

    def _learn(self, texts: list[bytes], odd: list[bool]) -> list[list[int]]:
        whole = iter(self.tok.encode_batch_fast([t.decode("utf-8") for t, o in zip(texts, odd, strict=True) if o], add_special_tokens=False))
        tokenize = self.model.tokenize
        return [next(whole).ids if o else [x.id for x in tokenize(t.decode("latin-1").translate(_LETTERS))] for t, o in zip(texts, odd, strict=True)]

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first index of each text's ids (n+1)); null counts as empty; ``end`` is put after each text."""
        whole: dict[int, np.ndarray] = {}
        wide = pa.array(np.zeros(len(column), bool))
        if self.style == "byte" and len(column):
            wide = pc.fill_null(pc.match_substring_regex(column, _WIDE_SPACE), False)
        for content in self.whole_if:
            wide = pc.or_(wide, pc.fill_null(pc.match_substring(column, content, ignore_case=self.style == "word"), False))
        if wide.true_count:
            for i in np.flatnonzero(wide.to_numpy(zero_copy_only=False)).tolist():
                whole[i] = np.array(self.tok.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
            column = pc.if_else(wide, "", column)
        ids, first = self._encode(column)
        if whole or end is not None:
            tail = [] if end is None else [np.array([end], np.uint32)]
            if whole:
                parts = [[whole[i] if i in whole else ids[first[i] : first[i + 1]], *tail] for i in range(len(column))]
                ids = np.concatenate([x for p in parts for x in p]) if parts else ids
                first = np.append(0, np.cumsum([sum(map(len, p)) for p in parts])).astype(np.int64)
            else:
                ids = np.insert(ids, first[1:], np.uint32(end))
                first = first + np.arange(len(first))
        return ids, first

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw(column)
        if self.style == "word":
            data = _FOLD[data]
        hashes, starts, stops, odds = [], [], [], []
        for a, b in self._blocks(data, offsets):
            lo, hi = np.searchsorted(offsets, a, "left"), np.searchsorted(offsets, b, "right")
            s, e, odd = self._bounds(data[a:b], offsets[lo:hi] - a)
            hashes.append(run_hashes(data[a:b], s, e))
            starts.append(s + a)
            stops.append(e + a)
            odds.append(odd)
        if not hashes:
            per_doc = np.zeros(len(offsets) - 1, np.int64)
            ids = np.zeros(0, np.uint32)
        else:
            start, stop, odd = np.concatenate(starts), np.concatenate(stops), np.concatenate(odds)
            at, sizes, table = self._lookup(np.concatenate(hashes), data, start, stop, odd)
            upto = np.cumsum(sizes)
            ids = table[np.repeat(at - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
            return ids, np.append(0, upto)[np.searchsorted(start, offsets, "left")]
        return ids, np.append(0, np.cumsum(per_doc))

    def _blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Like ``blocks``; inside a text the cut goes in front of white space, which starts a pre-token."""
        at = 0
        for a, b in blocks(data, offsets):
            if b <= at:
                continue
            if b < len(data) and offsets[np.searchsorted(offsets, b)] != b:
                back = b - 1
                while back > at and SPACE[data[back]]:
                    back -= 1
                if back + 1 > at and SPACE[data[back + 1]] and not SPACE[data[back]]:
                    b = back + 1
                else:
                    continue
            yield at, b
            at = b
        if at < len(data):
            yield at, len(data)

    def _lookup(self, hashes, data, start, stop, odd) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first id of each occurrence, number of its ids, the ids the places are in)."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED and len(self.known):
                self._forget()
                return self._lookup(hashes, data, start, stop, odd)
            where = first[new]
            bodies = [data[a:b].tobytes() for a, b in zip(start[where].tolist(), stop[where].tolist(), strict=True)]
            sizes, flat = self._flat(bodies, odd[where])
            place, widths = at[new], stop[where] - start[where]
            self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, place, sizes)
            self.body_at = np.insert(self.body_at, place, len(self.body) + np.cumsum(widths) - widths)
            self.body_size = np.insert(self.body_size, place, widths)
            self.known = np.insert(self.known, place, distinct[new])
            self.ids = np.concatenate([self.ids, flat])
            self.body = np.concatenate([self.body, np.frombuffer(b"".join(bodies), np.uint8)])
            at = np.searchsorted(self.known, distinct)
        which = at[inverse]
        begin, size, table = self.at[which], self.size[which], self.ids
        if len(other := self._others(which, data, start, stop)):  # another pre-token has this hash
            sizes, flat = self._flat([data[a:b].tobytes() for a, b in zip(start[other].tolist(), stop[other].tolist(), strict=True)], odd[other])
            begin[other], size[other] = len(table) + np.cumsum(sizes) - sizes, sizes
            table = np.concatenate([table, flat])
        return begin, size, table

    def _flat(self, bodies: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self._learn(bodies, odd.tolist())
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return sizes, np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))

    def _others(self, which, data, start, stop, together: int = 1 << 19) -> np.ndarray:
        """The occurrences whose bytes are not those of the table."""
        width = stop - start
        wrong = width != self.body_size[which]
        here = np.flatnonzero(~wrong)
        upto = np.append(0, np.cumsum(width[here]))
        at = 0
        while at < len(here):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + together, "right")) - 1)
            part, n = here[at:to], width[here[at:to]]
            inner = np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], n)
            differs = data[np.repeat(start[part], n) + inner] != self.body[np.repeat(self.body_at[which[part]], n) + inner]
            if differs.any():
                wrong[np.repeat(part, n)[differs]] = True
            at = to
        return np.flatnonzero(wrong)
