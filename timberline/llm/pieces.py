"""Byte-level BPE pieces in NumPy: where a pre-tokenizer cuts, and ids of the cut pieces.

``public_tokenizers.PATTERN`` walks a text from left to right and remembers
nothing but its position, so cuts can be found for many texts at once from the
character classes. Two facts make joins provable:

* matching again from any true cut gives the same cuts from there on;
* a cut at least ``MARGIN`` characters before the end of what is visible does
  not depend on what follows (the pattern looks one character past a white
  space run and three into a contraction; a special string has 13).

Equal pieces have equal ids, so a worker encodes each distinct piece once and
keeps it in a bounded :class:`PieceIds`. Pieces are looked up by a hash, and every hit is
compared letter by letter: hashes decide how fast a look-up is, never what it gives.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

MARGIN = 32
SLICE = 1 << 19
SLOTS = 1 << 20
OTHER, LETTER, NUMBER, SPACE, WALL, SPECIAL = range(6)
_ODD = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point by the Unicode properties the pattern names."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for match in regex.finditer(pattern, every):
            a, b = ord(match.group()[0]), ord(match.group()[-1])
            table[a : b + 1] = kind
    return table


@functools.cache
def _char_values() -> np.ndarray:
    z = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_ODD)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(_ODD, -1, 1 << 64)
    up = np.full(n, _ODD, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Pieces:
    """Pieces of several texts: ``start``/``end`` in ``joined``, ``owner`` the text's number, ``base`` where it begins."""

    def __init__(self, texts: list[str], special: str | None = None, cuts: bool = True):
        self.joined = joined = "\0".join(texts) + "\0"
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        walls = np.cumsum(lengths + 1) - 1
        self.base = walls - lengths
        self.codes = cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not cuts:
            return
        cls = char_classes()[cp]
        cls[walls] = WALL
        forced = [walls, walls + 1]
        if special and special in joined:
            at = joined.find(special)
            while at >= 0:
                cls[at : at + len(special)] = SPECIAL
                forced.append(np.array([at, at + len(special)]))
                at = joined.find(special, at + len(special))
        begins = self._begins(cp, cls, np.concatenate(forced))
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(cp))
        keep = cls[start] != WALL
        self.start, self.end = start[keep], end[keep]
        self.owner = np.searchsorted(walls, self.start)

    @staticmethod
    def _begins(cp: np.ndarray, cls: np.ndarray, forced: np.ndarray) -> np.ndarray:
        n = len(cp)
        begins = np.empty(n, bool)
        begins[0] = True
        np.not_equal(cls[1:], cls[:-1], out=begins[1:])
        begins[forced[forced < n]] = True
        run = np.flatnonzero(begins)
        after = np.append(run[1:], n)
        # White space before something visible gives its last character away: a blank joins what follows.
        ahead = cls[np.minimum(after, n - 1)]
        gives = (cls[run] == SPACE) & (after < n) & (ahead <= NUMBER)
        last, follow = after[gives] - 1, after[gives]
        begins[last] = True
        begins[follow[cp[last] == 32]] = False
        # Contractions begin at an apostrophe that begins a piece.
        q = run[(cp[run] == 39) & (cls[run] == OTHER)]
        q = q[(q + 1 < n)]
        q = q[begins[q] & (cls[q + 1] == LETTER)]
        if len(q):
            one = cp[q + 1]
            two = np.where(cls[np.minimum(q + 2, n - 1)] == LETTER, cp[np.minimum(q + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            size = np.where(short, 2, np.where(long, 3, 0))
            q, size = q[size > 0], size[size > 0]
            begins[q + 1] = False
            rest = q + size
            begins[rest[cls[rest] == LETTER]] = True
        return begins

    def hashes(self) -> np.ndarray:
        """One 64-bit value per distinct piece."""
        bits = len(self.codes).bit_length()
        up, down = _powers(18 if bits <= 18 else max(20, bits))  # few sizes: each stays in the worker
        total = np.cumsum(_char_values()[self.codes] * up[: len(self.codes)], dtype=np.uint64)
        before = np.where(self.start > 0, total[self.start - 1], np.uint64(0))
        value = (total[self.end - 1] - before) * down[self.start]
        value ^= (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return value ^ (value >> np.uint64(29))

    def strings(self, at: np.ndarray) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def _unlike(pieces: Pieces, letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers of the pieces that differ somewhere from ``letters`` at ``place`` (one for each) on."""
    codes, start = pieces.codes, pieces.start
    low = int(start[0])
    at = np.repeat(place - start, np.diff(np.append(start, len(codes))))
    at += np.arange(low, len(codes))
    wrong = np.flatnonzero(letters.take(at, mode="clip") != codes[low:]) + low
    piece = np.searchsorted(start, wrong, "right") - 1
    return np.unique(piece[wrong < pieces.end[piece]])  # what stands between pieces is no letter


class PieceIds:
    """Ids of pieces, each distinct one encoded once; emptied when it holds more than ``most`` pieces.

    ``encode`` gives the ids of some pieces one after the other, and their numbers.
    """

    def __init__(self, encode, most: int = 500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)  # hashes in order, and which entry each is
        self.entry = np.zeros(0, np.int64)
        self.slot = np.zeros(SLOTS, np.int64)  # the entry last found for some bits of a hash
        self.value = np.zeros(0, np.uint64)  # of entries as they came: hash, ids, letters
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)
        self.letters = np.zeros(0, np.uint32)  # of all pieces held, one after the other
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.room = {}  # the arrays' memory, with a place for what comes next

    def _extend(self, name: str, values: np.ndarray) -> None:
        """Append to an array; its room grows by a quarter, so that few calls copy what is held."""
        held = getattr(self, name)
        room, size = self.room.get(name, held), len(held) + len(values)
        if size > len(room):
            room = self.room[name] = np.empty(size + size // 4, held.dtype)
            room[: len(held)] = held
        room[len(held) : size] = values
        setattr(self, name, room[:size])

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Append the ids of ``strings`` to ``flat``: where each begins, and how many there are."""
        flat, n = self.encode(strings)
        begin = len(self.flat) + np.cumsum(n) - n
        self._extend("flat", flat)
        return begin, n

    def find(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Position in ``flat`` and number of ids of every piece."""
        if len(pieces.start) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        codes, start, size = pieces.codes, pieces.start, pieces.end - pieces.start
        if max(len(self.key), len(self.flat) // 16, len(self.letters) // 64) > self.most:
            self.clear()
        hashes = pieces.hashes()
        # Most pieces are found by a part of their hash; only the others are sorted and searched.
        slot = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        held = self.slot.take(slot)
        other = np.flatnonzero(self.value.take(held) != hashes) if len(self.value) else np.arange(len(hashes))
        if len(other):
            held[other] = self._entries(pieces, hashes, other)
            self.slot[slot[other]] = held[other]
        # A piece whose hash meets one of other letters is encoded on its own.
        where, n = self.at.take(held), self.n.take(held)
        wrong = np.union1d(_unlike(pieces, self.letters, self.place.take(held)), np.flatnonzero(self.size.take(held) != size))
        if len(wrong):
            where[wrong], n[wrong] = self._encoded(pieces.strings(wrong))
        return where, n

    def _entries(self, pieces: Pieces, hashes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Entries of some pieces by their whole hashes; those of new hashes are made."""
        value, first, back = np.unique(hashes[which], return_index=True, return_inverse=True)
        first = which[first]
        at = np.searchsorted(self.key, value)
        new = np.ones(len(value), bool)
        inside = at < len(self.key)
        new[inside] = self.key[at[inside]] != value[inside]
        if new.any():
            start, width = pieces.start[first[new]], (pieces.end - pieces.start)[first[new]]
            begin, n = self._encoded(pieces.strings(first[new]))
            ends = np.cumsum(width)
            letters = np.arange(int(ends[-1])) + np.repeat(start - (ends - width), width)
            entries = len(self.value) + np.arange(len(start))
            self.key, self.entry = np.insert(self.key, at[new], value[new]), np.insert(self.entry, at[new], entries)
            self._extend("place", len(self.letters) + ends - width)
            for name, values in (("value", value[new]), ("size", width), ("letters", pieces.codes[letters]), ("at", begin), ("n", n)):
                self._extend(name, values)
            at = np.searchsorted(self.key, value)
        return self.entry[at][back]

    def ids(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of the found pieces, one after the other."""
        total = int(n.sum())
        step = np.repeat(at - (np.cumsum(n) - n), n)
        return self.flat.take(step + np.arange(total))


def steps(text: str, special: str | None = None, size: int = SLICE):
    """Cut a text into whole-piece parts of about ``size`` characters, each cut proven stable.

    A part ends in something visible: white space before an end would be cut otherwise than before a word.
    """
    at = 0
    while len(text) - at > size:
        width = size
        while True:
            part = text[at : at + width]
            if at + width >= len(text):
                break
            found = Pieces([part], special)
            ends = found.end[found.end <= len(part) - MARGIN]
            ends = ends[char_classes()[found.codes[ends - 1]] != SPACE]
            if len(ends):
                part = part[: int(ends[-1])]
                break
            width *= 2
        yield part
        at += len(part)
    if at < len(text) or at == 0:
        yield text[at:]


def groups(texts: list[str], special: str | None = None, size: int = SLICE):
    """Runs of ``(parts, owners)`` of bounded total length covering every text."""
    parts, owners, total = [], [], 0
    for owner, text in enumerate(texts):
        for part in [text] if len(text) <= size else steps(text, special, size):
            if total + len(part) > size and parts:
                yield parts, owners
                parts, owners, total = [], [], 0
            parts.append(part)
            owners.append(owner)
            total += len(part)
    if parts:
        yield parts, owners


def count_texts(texts: list[str], cache: PieceIds, special: str | None = None) -> np.ndarray:
    """Number of ids of every text."""
    out = np.zeros(len(texts), np.int64)
    for parts, owners in groups(texts, special):
        pieces = Pieces(parts, special)
        _, n = cache.find(pieces)
        out += np.bincount(np.asarray(owners)[pieces.owner], weights=n, minlength=len(texts)).astype(np.int64)
    return out


def encode_texts(texts: list[str], cache: PieceIds, special: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and the number of ids of every text."""
    out, count = [], np.zeros(len(texts), np.int64)
    for parts, owners in groups(texts, special):
        pieces = Pieces(parts, special)
        at, n = cache.find(pieces)
        out.append(cache.ids(at, n))
        count += np.bincount(np.asarray(owners)[pieces.owner], weights=n, minlength=len(texts)).astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), count


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies, keyed by the letter of that code point."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


@functools.cache
def library_cache(path: str) -> PieceIds:
    """Pieces as the tokenizers library encodes them with the byte-level BPE file at ``path``.

    Pieces are cut already, so they go to the library's model itself, as letters that stand for bytes. A
    file with more than byte-level BPE in it (a normalizer, another pre-tokenizer) is refused.
    """
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    parts = json.loads(tokenizer.to_str())
    before = parts["pre_tokenizer"] or {}
    if parts["model"]["type"] != "BPE" or parts["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError(f"{path} is not plain byte-level BPE")
    tokenize, letters = tokenizer.model.tokenize, _byte_letters()
    letter_of = np.array([ord(letters[b]) for b in range(256)], np.uint32)
    whole = {t["content"]: [t["id"]] for t in parts["added_tokens"]}

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # All pieces get their letters at once; the byte between them stands in no UTF-8.
        data = np.frombuffer(b"\xff".join(map(str.encode, pieces)), np.uint8)
        spelled = letter_of[data].tobytes().decode("utf-32-le").split(letters[0xFF])
        flat, n = [], []
        for text, spelling in zip(pieces, spelled, strict=True):
            ids = whole[text] if text in whole else [t.id for t in tokenize(spelling)]
            flat += ids
            n.append(len(ids))
        return np.array(flat, np.int32), np.array(n, np.int32)

    return PieceIds(encode)


@functools.cache
def rank_encoding(path: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
