"""Splitting texts into words and looking up their token ids with array operations.

A batch of texts becomes one array of code points.  Words are the runs that the
split patterns of byte-level tokenizers find, told from the class of each code
point, which the tokenizers library's own patterns tell.  Every word gets a
64-bit polynomial hash; ids of words already seen come from a direct-mapped
table, once their code points are found to be the same, and only new words are
encoded one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points that count as white space (fixed values: Unicode's White_Space).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points taken at a time; a longer text comes alone.
CHUNK = 1 << 16
#: Slots for words and room for their ids (twice as much for their code points): 20 MiB of a worker in all.
_SLOT_BITS = 18
_POOL = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """The class of each code point by Python's tables."""
    if "classes" not in _tables:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        out[WHITE_SPACE] = SPACE
        _tables["classes"] = out
    return _tables["classes"]


def every_point() -> np.ndarray:
    """All code points that a text can have."""
    return np.r_[0:0xD800, 0xE000:0x110000]


def split_classes() -> np.ndarray:
    """The class of each code point as the tokenizers library's patterns see it; its Unicode version may differ from Python's."""
    if "split" not in _tables:
        from tokenizers import Regex, pre_tokenizers  # not for those who only hash words

        points_ = every_point()
        whole = points_.astype("<u4").tobytes().decode("utf-32-le")
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(whole):
                out[points_[a:b]] = kind
        _tables["split"] = out
    return _tables["split"]


def share(spark):
    """The split classes, made once on the driver and broadcast (a byte for each code point); a task that calls ``use`` with them needn't make its own."""
    return spark.sparkContext.broadcast(split_classes())


def use(shared) -> None:
    if "split" not in _tables:
        _tables["split"] = shared.value


def _mix_table() -> np.ndarray:
    if "mix" not in _tables:
        _tables["mix"] = np.random.default_rng(7).integers(1, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["mix"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "power" not in _tables or len(_tables["power"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("power", _MULTIPLIER), ("inverse", pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["power"], _tables["inverse"]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins, with the end."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_mix_table()[cp] * power[: len(cp)], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h ^= (h >> np.uint64(29)) ^ (end - start).astype(np.uint64)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)) | np.uint64(1)


def _runs(cp: np.ndarray, at: np.ndarray):
    kind = split_classes()[cp]
    new = np.empty(len(cp), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    edge = np.zeros(len(cp) + 1, bool)
    edge[at] = True
    new |= edge[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(cp))
    return start, end, kind[start], edge


def _contractions(cp, start, end, kind, edge, free):
    """How many letters each run's apostrophe takes from the next run."""
    took = np.zeros(len(start), np.int64)
    k = np.flatnonzero(free & (kind == OTHER) & (end - start == 1) & (cp[start] == 0x27) & ~edge[end])
    k = k[k + 1 < len(start)]
    k = k[kind[k + 1] == LETTER]
    a = cp[end[k]]
    b = np.where(end[k + 1] - start[k + 1] > 1, cp[np.minimum(end[k] + 1, len(cp) - 1)], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    took[k] = np.where(one, 1, np.where(two, 2, 0))
    return took


def byte_words(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    if not len(cp):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, end, kind, edge = _runs(cp, at)
    space = kind == SPACE
    last = edge[end]
    after = np.zeros(len(start), bool)
    after[1:] = space[:-1] & (cp[start[1:] - 1] == 0x20) & ~edge[start[1:]]
    after &= ~space
    took = _contractions(cp, start, end, kind, edge, ~after)
    begin, stop = start - after, end + took
    begin[1:] += took[:-1]
    # A run of spaces leaves its last one to what follows: joined to it if it is a blank, else alone.
    lone = space & ~last & (cp[end - 1] != 0x20)
    stop = np.where(space & ~last, end - 1, stop)
    begin, stop = np.r_[begin, end[lone] - 1], np.r_[stop, end[lone]]
    keep = stop > begin
    begin, stop = begin[keep], stop[keep]
    order = np.argsort(begin, kind="stable")
    return begin[order], stop[order]


def lower_words(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``."""
    if not len(cp):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, end, kind, edge = _runs(cp, at)
    took = _contractions(cp, start, end, kind, edge, np.ones(len(start), bool))
    begin, stop = start.copy(), end + took
    begin[1:] += took[:-1]
    keep = (kind != SPACE) & (kind != NUMBER) & (stop > begin)
    digits = np.flatnonzero(split_classes()[cp] == NUMBER)
    begin, stop = np.r_[begin[keep], digits], np.r_[stop[keep], digits + 1]
    order = np.argsort(begin, kind="stable")
    return begin[order], stop[order]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first, first+1, ... of every range, one after the other."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)


class Lookup:
    """Ids of words; ``encode`` gives those of a word not seen yet.  A word is known by its code points; its hash only says where to look."""

    def __init__(self, split: Callable, encode: Callable[[str], list[int]]):
        self.split, self.encode = split, encode
        self.clear()

    def clear(self):
        self.key = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.first = np.zeros(1 << _SLOT_BITS, np.int64)
        self.count = np.zeros(1 << _SLOT_BITS, np.int32)
        self.pool = np.zeros(_POOL, np.int32)
        self.used = 0
        self.place = np.zeros(1 << _SLOT_BITS, np.int64)
        self.size = np.zeros(1 << _SLOT_BITS, np.int32)
        self.points = np.zeros(2 * _POOL, np.uint32)
        self.filled = 0

    def words(self, texts: list[str]):
        """Starts, ends, ids of all words and how many ids each word has; with the texts' starts."""
        cp, at = points(texts)
        start, end = self.split(cp, at)
        size = end - start
        h = hashes(cp, start, end)
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        known = (self.key[slot] == h) & (self.size[slot] == size)
        own = np.flatnonzero(known)
        known[own[_unlike(cp, start[own], self.points, self.place[slot[own]], size[own])]] = False
        miss = np.flatnonzero(~known)
        extra = np.empty(0, np.int32)
        first, count = self.first[slot], self.count[slot]
        if len(miss):
            _, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            # Words of one hash but other code points than its first word are each looked at alone.
            odd = (size[miss] != size[miss[where]][back]) if len(miss) else back
            like = np.flatnonzero(~odd)
            odd[like[_unlike(cp, start[miss[like]], cp, start[miss[where]][back[like]], size[miss[like]])]] = True
            if odd.any():
                back[odd] = len(where) + np.arange(int(odd.sum()))
                where = np.r_[where, np.flatnonzero(odd)]
            joined, encode, ids, n = "".join(texts), self.encode, [], np.empty(len(where), np.int32)
            for k, w in enumerate(miss[where]):
                got = encode(joined[start[w] : end[w]])
                n[k] = len(got)
                ids += got
            extra = np.array(ids, np.int32)
            begin = np.cumsum(n) - n
            first[miss], count[miss] = begin[back] - len(extra), n[back]  # negative: counted from the end of the pool and extra together
        pool = np.concatenate([self.pool[: self.used], extra])
        first = np.where(first < 0, first + len(pool), first)
        out = pool[spread(first, count)]
        if len(miss):
            new = miss[where]
            total = int(size[new].sum())
            if self.used + len(extra) > _POOL or self.filled + total > len(self.points):
                self.clear()
            if len(extra) <= _POOL and total <= len(self.points):
                at_slot = slot[new]
                self.key[at_slot], self.first[at_slot], self.count[at_slot] = h[new], begin + self.used, n
                self.place[at_slot], self.size[at_slot] = self.filled + np.cumsum(size[new]) - size[new], size[new]
                self.pool[self.used : self.used + len(extra)] = extra
                self.points[self.filled : self.filled + total] = cp[spread(start[new], size[new])]
                self.used += len(extra)
                self.filled += total
        return start, end, out, count, at


def _unlike(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of those ranges of a and b, of the same sizes, that don't hold the same."""
    if not len(size):
        return np.empty(0, np.int64)
    wrong = np.flatnonzero(a[spread(a_first, size)] != b[spread(b_first, size)])
    return np.unique(np.searchsorted(np.cumsum(size), wrong, "right")) if len(wrong) else wrong


_SAFE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def parts(text: str, most: int = CHUNK) -> list[str]:
    """A long text in parts that byte-level patterns split as they split the whole: cut before a blank between two letters."""
    out, at = [], 0
    while len(text) - at > most and (m := _SAFE.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with up to ``most`` code points, or one longer text."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if len(texts) > begin:
        yield begin, len(texts)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


def require(spec: dict, path: str, wanted: dict) -> None:
    """Raise unless a vocabulary file cuts and joins texts as the encoder does that reads it; ``wanted``: what its parts have to be."""
    for place, value in wanted.items():
        found = spec
        for name in place.split("."):
            found = found.get(name) if isinstance(found, dict) else None
        if (found or None) != (value or None):
            raise ValueError(f"{path}: {place} is {found!r}, and this encoder knows {value!r} alone")
