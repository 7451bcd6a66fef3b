"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at the positions of a fixed mask; the mask's gaps ignore a word each, so a passage with
single words replaced still shares seeds with its source. Seeds of every position of every document are joined to those
of the test items; around each hit the two texts are laid along that diagonal. An overlap counts if any stretch has enough
equal words (`min_words`, or four fifths of a shorter item) and at least four fifths of its words are equal. Reported is the
stretch of the best score, where a replaced word costs four equal ones, or if that one doesn't count, the one with the most
equal words of those that do.

No such overlap is missed. From 14 words on, the three masks leave no way to replace up to a fifth of the words without a
seed between them (tests go through all ways for 14 to 29 words; a longer stretch holds a shorter one that counts too). A
shorter item may lose k words; its positions are dealt into k + 1 masks by turns, one of which must be left whole.

Hits are kept as seeds and items, not as places: where an item and a document hold one seed so often that their places would
be more than four times the diagonals, all diagonals are counted instead, so that repeated words cost no product of their numbers.
Diagonals with too few equal words are dropped in arrays; of the others the one with the most equal words is looked at first. Of
stretches as good on two diagonals that on the lesser one (start in the document less start in the item) is reported.

The test set is the stated query set: it is indexed in blocks of bounded size (`block_bytes` of text), each sent to the
tasks, so it may grow without limit; documents are read once for each block and never shuffled.

Words are split at ASCII white space and compared in lower case by their letters, digits and underscores only; what has
none of these is no word. Edge cases: null text has no words; repeated documents are each reported, repeated items (id and
text) once; null ids are kept; an empty test set reports nothing; an item's id column gets "item_" in front where its name is
that of the documents' id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terraloom.llm.common import take_turn, utf8, with_computed

MASKS = ((0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5))
#: items of fewer words get masks of their own
SHORT = 14
#: documents whose words are looked up together
ROWS = 400
LEAST = 12
COST = 4
_OTHER = re.compile(r"\W+")
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


class _Words(dict):
    """Word as written -> 64-bit hash of what counts of it (0: nothing), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        plain = word.lower()
        if not plain.isalnum():  # not ASCII letters and digits alone
            plain = plain.rstrip(b".,")
            if not plain.isalnum():
                plain = _OTHER.sub("", plain.decode("utf-8", "replace").lower()).encode()
        self[word] = h = xxhash.xxh64_intdigest(plain) | 1 if plain else 0
        return h


_HASHES = _Words()


def words(raw: bytes | None) -> np.ndarray:
    """Hash of each word of a text."""
    return words_of(pa.array([raw], pa.binary()))[0]


def words_of(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (binary), one after another, and where each text ends."""
    take_turn("words", _HASHES.clear)
    split = pc.ascii_split_whitespace(pc.fill_null(raw, b"").view(pa.string()))
    coded = split.flatten().dictionary_encode()
    own = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    h = np.fromiter(map(_HASHES.__getitem__, own), np.uint64, len(own))[coded.indices.to_numpy()]
    some = h != 0
    ends = np.r_[0, np.cumsum(some)][np.cumsum(split.value_lengths().to_numpy().astype(np.int64))]
    return h[some], ends


def seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Seed at every position where the mask fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, sum((k + 1) * (o + 1) * 2654435761 for k, o in enumerate(mask)) + len(mask), np.uint64)
    for k, o in enumerate(mask):
        out += tokens[o : o + n] * (_PRIMES[k % 5] + np.uint64(2 * k))
    return out


def needed(words: int, min_words: int) -> int:
    """How many equal words an overlap with an item of so many words needs."""
    return min(min_words, -(-4 * words // 5))


class Index:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.tokens = [words(t) for _, t in items]
        found: dict[tuple[int, ...], list[tuple[np.ndarray, int, np.ndarray]]] = {m: [] for m in MASKS}
        for k, t in enumerate(self.tokens):
            if len(t) >= SHORT:
                own = [(m, 0, t) for m in MASKS]
            else:
                turns = len(t) - needed(len(t), LEAST) + 1
                own = [(tuple(range(0, len(t) - c, turns)), c, t[c:][: (len(t) - c - 1) // turns * turns + 1]) for c in range(turns)] if len(t) else []
            for m, first, part in own:
                h = seeds(part, m)
                found.setdefault(m, []).append((h, k, first + np.arange(len(h))))
        #: by mask: sorted seeds, items and positions, and a table of the seeds' first bits
        self.masks = []
        for m, parts in found.items():
            h = np.concatenate([np.empty(0, np.uint64), *[x[0] for x in parts]])
            order = np.argsort(h, kind="stable")
            item = np.concatenate([np.empty(0, np.int64), *[np.full(len(x[0]), x[1]) for x in parts]])[order]
            pos = np.concatenate([np.empty(0, np.int64), *[x[2] for x in parts]])[order]
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            if len(h):
                self.masks.append((m, h[order], item, pos, seen))

    def find(self, raw: bytes | None, min_words: int) -> list[tuple[int, int, int, int, int]]:
        return self.find_all(pa.array([raw], pa.binary()), min_words)[0]

    def find_all(self, raw: pa.Array, min_words: int) -> list[list[tuple[int, int, int, int, int]]]:
        """Of each text (item, start in document, start in item, words, equal words) of the best overlap with each item."""
        tokens, ends = words_of(raw)
        out: list[list] = [[] for _ in range(len(raw))]
        begin = np.r_[0, ends]
        size = np.diff(begin)
        length = np.array([len(t) for t in self.tokens], np.int64)
        few = []
        for mask, hashes, items, pos, seen in self.masks:
            h = seeds(tokens, mask)
            at = np.flatnonzero(seen.take(h >> np.uint64(44), mode="clip"))
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            doc = np.searchsorted(ends, at, "right")
            real = (low < high) & (at + mask[-1] < ends[doc])
            at, low, doc, n = at[real], low[real], doc[real], (high - low)[real]
            # a seed that an item has again and again would meet each of its places in a text: such pairs are counted first
            first = np.r_[True, (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])] if len(hashes) else np.empty(0, bool)
            start = np.flatnonzero(first)
            runs = np.diff(np.r_[start, len(hashes)])
            g0, g1 = np.searchsorted(start, low), np.searchsorted(start, low + n)
            k = g1 - g0
            group = np.repeat(g0 - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            few.append((np.repeat(doc, k), items[start[group]], np.repeat(at, k), start[group], runs[group], pos))
        pair = [f[0] * len(length) + f[1] for f in few]
        if not sum(map(len, pair)):
            return out
        names, which = np.unique(np.concatenate(pair), return_inverse=True)
        hits = np.bincount(which, weights=np.concatenate([f[4] for f in few]))
        crowded = hits > 4 * (size[names // len(length)] + length[names % len(length)])
        few_ = np.split(~crowded[which], np.cumsum([len(f[0]) for f in few])[:-1])
        sparse = []
        for (doc, item, at, start, runs, pos), ok in zip(few, few_, strict=True):
            doc, item, at, start, runs = (x[ok] for x in (doc, item, at, start, runs))
            own = np.repeat(start - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
            sparse.append(np.stack([np.repeat(doc, runs), np.repeat(item, runs), np.repeat(at - begin[doc], runs) - pos[own]], axis=1))
        many = [self._counted(tokens[begin[d] : begin[d + 1]], int(d), int(i)) for d, i in zip(names[crowded] // len(length), names[crowded] % len(length), strict=True)]
        found = np.concatenate([self._equal(tokens, begin, np.unique(np.concatenate(sparse), axis=0)), *many])
        need = np.array([needed(n, min_words) for n in length])
        found = found[found[:, 3] >= need[found[:, 1]]]
        found = found[np.lexsort((found[:, 2], -found[:, 3], found[:, 1], found[:, 0]))]  # of each pair the most equal words first
        best: dict[tuple[int, int], tuple[bool, int, int, tuple[int, int, int, int, int]]] = {}
        for doc, item, diagonal, equal in found.tolist():
            top = best.get((doc, item))
            if top and top[0] and (equal < top[1] or equal == top[1] and diagonal > -top[2]):
                continue  # it can't be better, nor as good and earlier
            got = overlap(self.tokens[item], tokens[begin[doc] : begin[doc + 1]], diagonal, min_words)
            if got and (top is None or (*got[:2], -diagonal) > top[:3]):
                best[doc, item] = (*got[:2], -diagonal, (item, *got[2]))
        for (doc, _), b in sorted(best.items()):
            out[doc].append(b[3])
        return out

    def _equal(self, tokens: np.ndarray, begin: np.ndarray, found: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
        """Rows (document, item, diagonal) with the number of equal words on that diagonal."""
        doc, item, diagonal = found.T
        length = np.array([len(t) for t in self.tokens], np.int64)
        flat, first = np.concatenate(self.tokens), np.r_[0, np.cumsum(length)][:-1]
        lo = np.maximum(0, -diagonal)
        n = np.maximum(0, np.minimum(length[item], np.diff(begin)[doc] - diagonal) - lo)
        count = np.zeros(len(found), np.int64)
        cuts = np.unique(np.r_[0, np.searchsorted(np.cumsum(n), np.arange(at_once, int(n.sum()), at_once)), len(n)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = n[a:b]
            step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            same = flat[np.repeat(first[item[a:b]] + lo[a:b], k) + step] == tokens[np.repeat(begin[doc[a:b]] + lo[a:b] + diagonal[a:b], k) + step]
            total = np.r_[0, np.cumsum(same)]
            count[a:b] = total[np.cumsum(k)] - total[np.cumsum(k) - k]
        return np.column_stack([found, count])

    def _counted(self, text: np.ndarray, doc: int, item: int, at_once: int = 1 << 21) -> np.ndarray:
        """All diagonals of a document and an item, with the number of equal words on each."""
        own = self.tokens[item]
        m = len(own)
        padded = np.concatenate([np.zeros(m, np.uint64), text, np.zeros(m, np.uint64)])  # no word has hash 0
        windows = np.lib.stride_tricks.sliding_window_view(padded, m)
        step = max(1, at_once // m)
        count = np.concatenate([(windows[k : k + step] == own).sum(axis=1) for k in range(0, len(windows), step)])
        rows = np.arange(len(windows)) - m
        return np.column_stack([np.full(len(rows), doc), np.full(len(rows), item), rows, count])


def overlap(own: np.ndarray, doc: np.ndarray, diagonal: int, min_words: int) -> tuple[bool, int, tuple[int, int, int, int]] | None:
    """Best stretch on a diagonal: whether it has the best score, equal words, (start in document, start in item, words, equal words)."""
    lo, hi = max(0, -diagonal), min(len(own), len(doc) - diagonal)
    same = own[lo:hi] == doc[lo + diagonal : hi + diagonal]
    need = needed(len(own), min_words)
    sums, count = np.r_[0, np.cumsum(np.where(same, 1, -COST))], np.r_[0, np.cumsum(same)]
    if count[-1] < need:
        return None
    low = np.minimum.accumulate(sums)
    gain = sums - low
    stretches = [(int(sums[: e + 1].argmin()), e) for e in np.flatnonzero(gain == gain.max()).tolist()]
    equal, n, begin, end = max((int(count[e] - count[b]), e - b, b, e) for b, e in stretches)
    top = equal >= need and 5 * equal >= 4 * n
    if not top:  # the best score is too short, or not equal enough: the most equal words of which four fifths are equal
        ends = np.flatnonzero(same) + 1
        starts = np.searchsorted(-low, -sums[ends], "left")
        k = int((count[ends] - count[starts]).argmax())
        begin, end = int(starts[k]), int(ends[k])
        begin += int(same[begin:end].argmax())
        equal, n = int(count[end] - count[begin]), end - begin
    return (top, equal, (begin + lo + diagonal, begin + lo, n, equal)) if equal >= need else None


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The test set in blocks of about `block_bytes`, as lists on the driver, one at a time."""
    raw = items.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_raw")).distinct()
    total = raw.agg(F.sum(F.length("_raw"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = raw.where(F.pmod(F.xxhash64("_id", "_raw"), F.lit(count)) == k).collect()
        if part:
            yield sorted(((r["_id"], bytes(r["_raw"])) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 12, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document and test item that overlap: ids, `doc_start`, `item_start`, `n_words`, `n_equal`."""
    if min_words < LEAST:
        raise ValueError(f"the masks find overlaps of {LEAST} words and more")
    kind = items.schema[item_col].dataType
    named = item_col if item_col != id_col else f"item_{item_col}"
    names = ["doc_start", "item_start", "n_words", "n_equal"]
    found_type = pa.list_(pa.struct([("item", to_arrow_type(kind)), *[(n, pa.int64()) for n in names]]))
    out = None
    for block in blocks(items, item_col, item_text, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(block))  # at most block_bytes of text

        def run(raw: pa.Array, index=index) -> list[pa.Array]:
            ids = index.value.ids
            found = [f for k in range(0, len(raw), ROWS) for f in index.value.find_all(raw.slice(k, ROWS), min_words)]
            return [pa.array([[{"item": ids[m[0]]} | dict(zip(names, m[1:], strict=True)) for m in f] for f in found], found_type)]

        part = with_computed(docs, [id_col], [text_col], run, [("m", f"array<struct<item: {kind.simpleString()}, " + ", ".join(f"{n}: bigint" for n in names) + ">>")])
        part = part.toDF("_id", "_m").where(F.size("_m") > 0).select("_id", F.explode("_m").alias("_m"))
        part = part.select(F.col("_id").alias(id_col), F.col("_m.item").alias(named), *[F.col(f"_m.{n}").alias(n) for n in names])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select(id_col).limit(0).select(id_col, F.lit(None).cast(kind).alias(named), *[F.lit(0).cast("long").alias(n) for n in names])
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 12, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents, all columns, that overlap no test item."""
    if min_words < LEAST:
        raise ValueError(f"the masks find overlaps of {LEAST} words and more")
    for block in blocks(items, item_col, item_text, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(raw: pa.Array, index=index) -> list[pa.Array]:
            return [pa.array([not f for k in range(0, len(raw), ROWS) for f in index.value.find_all(raw.slice(k, ROWS), min_words)], pa.bool_())]

        docs = with_computed(docs, docs.columns, [text_col], run, [("ok", "boolean")], only=0)
    return docs
