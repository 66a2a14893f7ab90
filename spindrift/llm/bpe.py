"""BPE encoding and decoding by tree concatenation.

A text is normalised and then halved, wherever its middle falls, until its
leaves are short; all leaves of a batch are encoded side by side, in array
operations, and tasks encode their documents in parallel.  The leaves of one
text stay in one task: a text is a value of one row, which one task holds
anyway.  At each join a window around the cut is
encoded again.  It has to begin with a word of the left side that ends before
the cut and to end with a word of the right side that begins after it; else it
grows to twice its reach, at most to both sides whole.  Words are found from
left to right, so what agrees at these two places agrees everywhere.

A word of very many symbols is halved and joined the same way, token by token:
a token sequence is the encoding of its text if every adjacent pair of tokens
is, and a window that begins and ends with the tokens that its neighbours
already had leaves no new pair outside it.

Defined results: a null text counts as empty and has no ids; strings of special
tokens in a text become those tokens, as the tokenizers library has it; rows
are independent, so ties, repeats and extra columns don't matter.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from spindrift.llm import segment
from spindrift.llm.common import bounded_batches, tidy

#: Code points of a leaf, and how far the first window reaches to either side of a cut.
LEAF, REACH = 4096, 48
#: Symbols of a word beyond which it is halved too.
WORD_LEAF = 128
END = "</w>"
SCHEMA = "doc_id long, ids binary, decoded string"


class Merger:
    """Merges of one word's symbols, lowest rank and then leftmost first."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: k for k, p in enumerate(pairs)}

    def merge(self, symbols: list[str]) -> list[tuple[str, int]]:
        parts = [(s, 1) for s in symbols]
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get((a, b), none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], parts[k][1] + parts[k + 1][1])]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((parts[k - 1][0], parts[k][0]), none)
            if k < len(ranks):
                ranks[k] = rank.get((parts[k][0], parts[k + 1][0]), none)
        return parts

    def tree(self, symbols: list[str]) -> list[tuple[str, int]]:
        """As ``merge``, by halves and windows."""
        if len(symbols) <= WORD_LEAF:
            return self.merge(symbols)
        cut = len(symbols) // 2
        left, right = self.tree(symbols[:cut]), self.tree(symbols[cut:])
        reach = 4
        while True:
            tail, head = left[-reach:], right[:reach]
            begin, stop = cut - sum(n for _, n in tail), cut + sum(n for _, n in head)
            whole_left, whole_right = begin == 0, stop == len(symbols)
            if whole_left and whole_right:
                return self.merge(symbols)
            window = self.merge(symbols[begin:stop])
            if len(window) > 1 and (whole_left or window[0] == tail[0]) and (whole_right or window[-1] == head[-1]):
                return left[: len(left) - len(tail)] + window + right[len(head) :]
            reach *= 2


#: What a vocabulary file has to say for ids to be the library's (fixed values).
KNOWN = {
    "normalizer.normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer.pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
    "decoder": None, "model.type": "BPE", "model.end_of_word_suffix": END, "model.continuing_subword_prefix": None, "model.dropout": None, "model.ignore_merges": False,
}


def _normalised(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def odd_points(normaliser) -> np.ndarray:
    """Which code points Python may normalise otherwise than the library, whose Unicode version is another.

    Those that Python doesn't know; those that differ alone, or beside marks of other classes; and the parts of pairs that differ when joined."""
    out = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    out[0xD800:0xE000] = True
    known = [chr(c) for c in np.flatnonzero(~out) if c >= 0x80 and not chr(c).isspace()]
    marks = [c for c in known if unicodedata.category(c)[0] == "M"]
    pairs = [unicodedata.decomposition(c).split() for c in known]
    pairs = ["".join(chr(int(x, 16)) for x in p) for p in pairs if len(p) == 2 and p[0][0] != "<"]
    tried = known + [f"q{c}\u0334" for c in marks] + [f"q\u0305{c}" for c in marks] + pairs
    for a in range(0, len(tried), 1 << 14):
        part = tried[a : a + (1 << 14)]
        got, own = normaliser.normalize_str("|".join(part)).split("|"), _normalised("|".join(part)).split("|")
        for text, x, y in zip(part, got, own, strict=True):
            if x != y:
                out[[ord(c) for c in text if ord(c) >= 0x80 and c not in "\u0334\u0305"]] = True
    return out


class TreeEncoder:
    """Encodes and decodes as the tokenizers library does with this vocabulary, of words with word ends."""

    def __init__(self, path: str, odd: np.ndarray | None = None):
        spec = json.load(open(path, encoding="utf-8"))
        segment.require(spec, path, KNOWN)
        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        vocab = spec["model"]["vocab"]
        self.merger = Merger(vocab, spec["model"]["merges"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in (vocab | added).items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        self.special = added
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.letters = dict(enumerate(segment.byte_letters()))
        self.normaliser = tokenizer.normalizer
        self.odd = odd_points(self.normaliser) if odd is None else odd
        self.words = segment.Lookup(segment.lower_words, self._word)

    def _word(self, word: str) -> list[int]:
        shown = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        if len(shown) <= WORD_LEAF:
            return [t.id for t in self.model.tokenize(shown)]
        vocab = self.merger.vocab
        return [vocab[t] for t, _ in self.merger.tree([*shown[:-1], shown[-1] + END])]

    def normalise(self, text: str) -> str:
        """As the library's normaliser, but for white space, which no word holds.  Texts with a code point that Python's tables
        may see otherwise go through the library itself."""
        if text.isascii():
            return text.lower()
        if self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return self.normaliser.normalize_str(text)
        return _normalised(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces, owner, fixed = [], [], {}
        for k, t in enumerate(texts):
            parts = self.special_at.split(t) if self.special_at and "<|" in t else [t]
            for p in parts:
                if p in self.special:
                    fixed[len(pieces)] = self.special[p]
                    p = ""
                pieces.append(self.normalise(p))
                owner.append(k)
        found = self._trees(pieces)
        for k, i in fixed.items():
            found[k] = np.array([i], np.int32)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, ids in zip(owner, found, strict=True):
            out[k].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _trees(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [_cuts(len(t)) for t in texts]
        leaves = [t[a:b] for t, c in zip(texts, cuts, strict=True) for a, b in zip(c, c[1:], strict=False)]
        nodes, k = [], 0
        encoded = self._encode(leaves)
        for c in cuts:
            n = len(c) - 1
            nodes.append([x.moved(a) for x, a in zip(encoded[k : k + n], c, strict=False)])
            k += n
        while any(len(x) > 1 for x in nodes):
            nodes = self._join_level(texts, nodes)
        return [x[0].ids if x else np.empty(0, np.int32) for x in nodes]

    def _encode(self, texts: list[str]) -> list[_Node]:
        out = []
        for a, b in segment.chunks(texts):
            start, end, ids, count, at = self.words.words(texts[a:b])
            first = np.searchsorted(start, at)
            total = np.r_[0, np.cumsum(count, dtype=np.int64)]
            for k in range(b - a):
                lo, hi = first[k], first[k + 1]
                out.append(_Node(0, len(texts[a + k]), start[lo:hi] - at[k], end[lo:hi] - at[k], count[lo:hi], ids[total[lo] : total[hi]]))
        return out

    def _join_level(self, texts, nodes):
        """Join the first with the second node of each text, the third with the fourth, and so on."""
        todo = [(d, k, REACH) for d, x in enumerate(nodes) for k in range(0, len(x) - 1, 2)]
        done = {}
        while todo:
            spans = [_window(nodes[d][k], nodes[d][k + 1], reach) for d, k, reach in todo]
            windows = self._encode([texts[d][s[0] : s[1]] for (d, _, _), s in zip(todo, spans, strict=True)])
            again = []
            for (d, k, reach), s, w in zip(todo, spans, windows, strict=True):
                joined = _join(nodes[d][k], nodes[d][k + 1], s, w.moved(s[0]))
                if joined is None:
                    again.append((d, k, 2 * reach))
                else:
                    done[d, k] = joined
            todo = again
        return [[done.get((d, k), x[k]) for k in range(0, len(x), 2)] for d, x in enumerate(nodes)]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.names[ids].tolist())


class _Node:
    """The words of text[begin:stop], taken as a text of its own."""

    def __init__(self, begin, stop, start, end, count, ids):
        self.begin, self.stop, self.start, self.end, self.count, self.ids = begin, stop, start, end, count, ids

    def moved(self, by: int) -> _Node:
        return _Node(self.begin + by, self.stop + by, self.start + by, self.end + by, self.count, self.ids)


def _cuts(n: int) -> list[int]:
    """0, the cuts that halving a text of this length makes, and its length; none for an empty text."""
    parts = 1
    while n > LEAF * parts:
        parts *= 2
    return [n * k // parts for k in range(parts + 1)] if n else [0]


def _window(left: _Node, right: _Node, reach: int):
    """Where the window begins and stops; the left word that it begins with and the right one it stops with, or -1 at an end."""
    cut = left.stop
    a = int(np.searchsorted(left.start, cut - reach, "right")) - 1
    b = int(np.searchsorted(right.end, cut + reach, "left"))
    begin = int(left.start[a]) if a >= 0 else left.begin
    stop = int(right.end[b]) if b < len(right.end) else right.stop
    return begin, stop, a, b if b < len(right.end) else -1


def _join(left: _Node, right: _Node, span, window: _Node):
    begin, stop, a, b = span
    cut = left.stop
    if a >= 0 and not (len(window.start) and window.start[0] == left.start[a] and window.end[0] == left.end[a] < cut):
        return None
    if b >= 0 and not (len(window.start) and window.end[-1] == right.end[b] and window.start[-1] == right.start[b] > cut):
        return None
    lo = max(a, 0)
    hi = b + 1 if b >= 0 else len(right.start)
    n_left, n_right = int(left.count[:lo].sum()), int(right.count[:hi].sum())
    return _Node(
        left.begin, right.stop, np.r_[left.start[:lo], window.start, right.start[hi:]], np.r_[left.end[:lo], window.end, right.end[hi:]],
        np.r_[left.count[:lo], window.count, right.count[hi:]], np.r_[left.ids[:n_left], window.ids, right.ids[n_right:]],
    )


_encoders: dict[str, TreeEncoder] = {}


def encoder(path: str, odd: np.ndarray | None = None) -> TreeEncoder:
    """The process's encoder; ``odd`` saves finding the odd code points again."""
    if path not in _encoders:
        _encoders[path] = TreeEncoder(path, odd)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id; ids: little-endian unsigned 32-bit integers; decoded: the text that these ids give."""
    spark = docs.sparkSession
    kinds, odd = segment.share(spark), spark.sparkContext.broadcast(encoder(path).odd)

    def run(batches):
        segment.use(kinds)
        tree = encoder(path, odd.value)
        try:
            yield from encoded(tree, batches)
        finally:
            tree.words.clear()  # what is known of words would stay with a worker that waits

    def encoded(tree, batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in segment.chunks(texts):
                ids = tree.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array([tree.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
