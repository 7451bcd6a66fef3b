"""SentencePiece encoding and decoding: best segmentation into pieces by a max-plus parallel scan.

The score of a segmentation is the sum of its pieces' scores, so the best one is a product of transfer matrices in the
(max, +) semiring. A document of at most `chunk` characters (32 Ki) is encoded in one go. A longer one is cut into chunks without
regard to its words; the state at a boundary is by how many characters the last piece runs over it. Then

1. every chunk yields its matrix T[i, j]: best score from entry state i to exit state j;
2. the matrices of a document are combined by an associative scan, which gives the best score of every entry state;
3. with those, every chunk finds which entry state each exit state goes back to; composing these small maps from the
   document's end fixes the state at every boundary;
4. every chunk is traced back on its own between its two states.

Scores are whole numbers, so any grouping gives the same sums; ties go to the longer last piece everywhere. The result
is the serial Viterbi result, whatever the chunk size.

Between such chunks, and in shorter documents, no piece goes on over a blank that follows a word, so every distinct word of a
batch is solved once, thousands of words side by side in arrays: one column a word, one step a character.

Scores: a unigram model's file holds log probabilities. A BPE model's file holds merge ranks instead; they are read as
ranks in a Zipf distribution, log p = -log(rank + 2). Byte-pair merging itself is greedy and no sum of scores, so for such
a model the ids are those of the best-scored segmentation into its pieces, not those of its merges; they decode to the
same text.

Text: a blank becomes U+2581, one is put in front, characters without a piece fall back to byte pieces (as the model does).
Edge cases: null and empty texts have no ids and decode to ""; U+2581 itself decodes to a blank; repeated rows and null ids
are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm.common import gather, materialize, take_turn, with_computed

BLANK = "▁"
NONE = -(1 << 60)
SCALE = 1000
#: characters of words that are solved together
CELLS = 1 << 16
#: documents whose words are solved together
ROWS = 500


class Trie:
    """The pieces of a vocabulary as arrays: node and character -> next node, in an open-addressing hash table."""

    EMPTY = np.uint64((1 << 64) - 1)
    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int], score: dict[str, int]):
        starts = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=len)
        node = {"": 0} | {p: k for k, p in enumerate(starts, 1)}
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in starts], np.uint64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, self.EMPTY), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.next[at[mine]] = left[mine] + 1
            left, at = left[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)
        #: id and score of the piece that ends at a node; no id: none does
        self.id = np.array([-1, *[pieces.get(p, -1) for p in starts]], np.int32)
        self.score = np.array([NONE, *[score.get(p, NONE) for p in starts]], np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node of each, 0 where there is none."""
        keys = node.astype(np.uint64) << np.uint64(21) | char
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.next[at], 0)
        open_ = np.flatnonzero((found != keys) & (found != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.next[at[open_[hit]]]
            open_ = open_[~hit & (found != self.EMPTY)]
        return out


class Vocabulary:
    """Pieces of a model file with whole-number scores."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        stored = {i: sp.get_score(i) for i in plain}
        ranked = sorted((-s for s in stored.values() if s > -1e8), reverse=False)
        ranks = len(ranked) > 1 and ranked[0] >= 0 and all(r == int(r) for r in ranked) and len(set(ranked)) == len(ranked)
        if ranks:
            stored = {i: -math.log(min(-s, 1e9) + 2) for i, s in stored.items()}
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(len(self.text)) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.id = {self.text[i]: i for i in plain}
        self.score = {p: round(stored[i] * SCALE) for p, i in self.id.items()}
        self.unknown_score = min(self.score.values()) - 10 * SCALE
        self.longest = max(map(len, self.id))
        self.part = {p[:k]: None for p in self.id for k in range(1, len(p))}
        self.part.update(self.score)  # a proper prefix that is no piece: None
        # no piece goes on over a blank that follows something else: words can be taken one by one
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.id)
        self.trie = Trie(self.id, self.score)
        # the bytes that each id stands for: a byte piece its byte, a control nothing
        told = [bytes([self.of_byte[i]]) if i in self.of_byte else b"" if i in self.silent else t.replace(BLANK, " ").encode() for i, t in enumerate(self.text)]
        self.told = pa.array(told, pa.binary())

    def spans(self, t: str, i: int) -> Iterator[tuple[int, int]]:
        """(end, score) of every piece at i, shortest first; a character without one counts as unknown."""
        part, end = self.part, min(len(t), i + self.longest)
        for j in range(i + 1, end + 1):
            s = part.get(t[i:j], 0)
            if s == 0:  # neither a piece nor the start of one (scores are negative)
                if j == i + 1:
                    yield j, self.unknown_score
                return
            if s is not None:
                yield j, s
            elif j == i + 1:
                yield j, self.unknown_score

    def ids_of(self, t: str) -> list[int]:
        found = self.id.get(t)
        return [found] if found is not None else [self.byte.get(b, self.unknown) for b in t.encode("utf-8", "surrogatepass")]

    def solve(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentation of each text, all of them together: scores, numbers of ids, and the ids one after another."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        score, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, places, at = [], [], 0
        while at < len(texts):
            some = order[at : at + max(1, CELLS // max(1, int(size[order[at]])))]
            at += len(some)
            score[some], count[some], ids = self._solve([texts[k] for k in some.tolist()], size[some])
            parts.append(ids)
            places.append(some)
        # from the order of length to the order given
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        begin = np.empty(len(texts), np.int64)
        begin[place] = np.cumsum(count[place]) - count[place]
        return score, count, gather(flat, begin, count)

    def _solve(self, texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """solve() for texts in falling order of length: one column a text, one row a character."""
        width, height = len(texts), int(size[0])
        if not height:
            return np.zeros(width, np.int64), np.zeros(width, np.int64), np.empty(0, np.int32)
        chars = np.zeros((width, height), np.uint64)
        inside = np.arange(height) < size[:, None]
        chars[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.ascontiguousarray(chars.T).ravel()
        cell = np.flatnonzero(inside.T.ravel())
        # piece (node of the trie) of every length at every place
        longest = min(self.longest, height)
        piece = np.zeros((longest, height * width), np.int32)
        node, now = np.zeros(len(cell), np.int32), cell
        for k in range(longest):
            node = self.trie.step(node, chars[now])
            going = node > 0
            cell, node, now = cell[going], node[going], now[going]
            piece[k, cell] = node
            now = now + width
            within = now < height * width
            cell, node, now = cell[within], node[within], now[within]
            if not len(cell):
                longest = k + 1
                break
        gain = self.trie.score[piece[:longest]].reshape(longest, height, width)
        gain[0][gain[0] == NONE] = self.unknown_score
        best, back = np.full((height + 1, width), NONE, np.int64), np.zeros((height + 1, width), np.int16)
        best[0] = 0
        live = np.searchsorted(-size, -np.arange(height + 1), "right").tolist()
        for end in range(1, height + 1):
            n = live[end]
            for k in range(min(end, longest), 0, -1):  # the longer last piece first: it wins ties
                s = best[end - k, :n] + gain[k - 1, end - k, :n]
                better = s > best[end, :n]
                np.copyto(best[end, :n], s, where=better)
                np.copyto(back[end, :n], k, where=better)
        # from the ends: (text, how many pieces follow, place, length)
        who, place, steps = np.flatnonzero(size > 0), size[size > 0], []
        while len(who):
            k = back[place, who]
            place = place - k
            steps.append((who, self.trie.id[piece[k - 1, place * width + who]], place))
            going = place > 0
            who, place = who[going], place[going]
        who, ids, place = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((place, who))
        who, ids, place = who[order], ids[order], place[order]
        n = np.ones(len(ids), np.int64)
        lone = np.flatnonzero(ids < 0)  # characters without a piece: their bytes
        if len(lone):
            spelled = [self.ids_of(texts[w][p]) for w, p in zip(who[lone].tolist(), place[lone].tolist(), strict=True)]
            n[lone] = list(map(len, spelled))
            first = np.cumsum(n) - n
            out = np.empty(int(n.sum()), np.int32)
            out[first] = ids
            for f, x in zip(first[lone].tolist(), spelled, strict=True):
                out[f : f + len(x)] = x
            ids = out
        return best[size, np.arange(width)], np.bincount(who, n, width).astype(np.int64), ids

    def words(self, t: str) -> list[str]:
        """Parts that can be taken one by one; each begins with a blank, but for the first one of a chunk."""
        if not self.by_word:
            return [t] if t else []
        out = t.split(BLANK)
        if "" not in out[1:]:
            return [x for x in (out[0], *[BLANK + w for w in out[1:]]) if x]
        parts, run = ([out[0]] if out[0] else []), ""
        for w in out[1:]:
            run += BLANK
            if w:
                parts.append(run + w)
                run = ""
        return [*parts, run] if run else parts

    def encode(self, text: str | None) -> bytes:
        """Ids of one text, little-endian 32-bit."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, how many each has, and scores. Every distinct word of the texts is solved once."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.or_(pc.match_substring(texts, BLANK), pc.match_substring(texts, "  ")), pc.match_substring_regex(texts, r"\A(?: |\z)| \z"))
        odd = odd if self.by_word else pa.array([True] * len(texts))
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        # words between single blanks, and parts of other texts; the blank that each begins with is left out
        parts = [[w[1:] for w in self.words(normal(t))] if t else [] for t in texts.filter(odd).to_pylist()]
        coded = pa.concat_arrays([plain.flatten(), pa.array(list(chain.from_iterable(parts)), pa.string())]).dictionary_encode()
        at = coded.indices.to_numpy()
        score, count, ids = self.solve([BLANK + w for w in coded.dictionary.to_numpy(zero_copy_only=False)])
        ends = np.cumsum(np.r_[0, plain.value_lengths().to_numpy(), np.fromiter(map(len, parts), np.int64, len(parts))])
        score = np.diff(np.r_[0, np.cumsum(score[at])][ends])
        ends = np.r_[0, np.cumsum(count[at])][ends]
        ids = gather(ids, (np.cumsum(count) - count)[at], count[at])
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        begin, count = ends[:-1][place], np.diff(ends)[place]
        return gather(ids, begin, count) if parts else ids, count, score[place]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Text, as UTF-8, of each of the runs of `count` ids; without the blank in front."""
        told = self.told.take(pa.array(ids))
        ends = np.frombuffer(told.buffers()[1], np.int32, len(ids) + 1, 4 * told.offset) if len(ids) else np.zeros(1, np.int32)
        raw = memoryview(told.buffers()[2] or b"")
        cut = ends[np.r_[0, np.cumsum(count)]].tolist()
        return [bytes(raw[i + (raw[i : i + 1] == b" ") : j]) for i, j in zip(cut, cut[1:], strict=False)]

    # --- chunks: t holds `size` characters of the chunk and up to longest - 1 of the next

    def cuts(self, t: str, size: int) -> tuple[int, int] | None:
        """First and last place where every segmentation has a boundary, none before the last entry state."""
        if not self.by_word:
            return None
        first = t.find(BLANK, max(1, self.longest - 1), size + 1)
        while first > 0 and t[first - 1] == BLANK:
            first = t.find(BLANK, first + 1, size + 1)
        if first < 0:
            return None
        last = t.rfind(BLANK, first, size + 1)
        while t[last - 1] == BLANK:
            last = t.rfind(BLANK, first, last)
        return first, last

    def middles(self, chunks: list[str], sizes: list[int]) -> list[tuple[tuple[int, int] | None, int, bytes]]:
        """Cuts of each chunk, score and ids (little-endian 32-bit) of what lies between."""
        cuts = [self.cuts(t, size) for t, size in zip(chunks, sizes, strict=True)]
        inner = [t[c[0] + 1 : c[1]].replace(BLANK, " ") if c and c[1] > c[0] else None for t, c in zip(chunks, cuts, strict=True)]
        out = []
        for k in range(0, len(inner), 32):  # a few chunks at a time: they are long
            ids, count, score = self.encode_all(pa.array(inner[k : k + 32], pa.string()))
            ends = np.r_[0, np.cumsum(count)].tolist()
            out += [(c, int(s), ids[i:j].tobytes()) for c, s, i, j in zip(cuts[k:], score, ends, ends[1:], strict=False)]
        return out

    def region(self, t: str, begin: int, stop: int, best: np.ndarray) -> np.ndarray:
        """Carry rows of scores (one row a position from `begin`) over the pieces that start before `stop`."""
        for i in range(begin, stop):
            row = best[i - begin]
            if (row > NONE // 2).any():
                for j, s in self.spans(t, i):
                    np.maximum(best[j - begin], row + s, out=best[j - begin])
        return best

    def transfer(self, t: str, size: int, cut: tuple[int, int] | None, middle: int) -> np.ndarray:
        """T[i, j] of a chunk, given its cuts and the score between them."""
        states = self.longest
        full = np.full((size + states, states), NONE, np.int64)[: (cut[0] + 1 if cut else None)]
        for i in range(min(states, len(full))):
            full[i, i] = 0
        if not cut:
            return self.region(t, 0, size, full)[size : size + states].T
        head = self.region(t[: cut[0]], 0, cut[0], full)[cut[0]]
        tail = np.full((size - cut[1] + states, 1), NONE, np.int64)
        tail[0] = 0
        tail = self.region(t, cut[1], size, tail)[size - cut[1] :, 0]
        return np.maximum(head[:, None] + middle + tail[None, :], NONE)

    def trace(self, t: str, size: int, alpha: np.ndarray, exits: list[int], cut: tuple[int, int] | None, middle: bytes | None) -> list[tuple[int, bytes]]:
        """Entry state and, unless middle (the ids between the cuts) is null, ids of the best path to each of `exits`, given the entry states' scores."""

        def forward(begin, stop, start: list[int], limit):
            best = start + [NONE] * (limit + 1 - begin - len(start))
            back = [-1] * len(best)
            for i in range(begin, stop):
                b = best[i - begin]
                if b > NONE // 2:
                    for j, s in self.spans(t[:limit], i):
                        if b + s > best[j - begin]:
                            best[j - begin], back[j - begin] = b + s, i
            return back

        def walk(back, begin, j):
            parts = []
            while back[j - begin] >= 0:
                i = back[j - begin]
                parts.append(t[i:j])
                j = i
            return j, parts[::-1]

        pack = lambda parts: np.array([k for p in parts for k in self.ids_of(p)], np.int32).tobytes()
        entry = [int(a) for a in alpha]
        if not cut:
            back = forward(0, size, entry, len(t))
            return [(i, pack(p) if middle is not None else b"") for i, p in (walk(back, 0, size + j) for j in exits)]
        i, parts = walk(forward(0, cut[0], entry, cut[0]), 0, cut[0])
        if middle is None:
            return [(i, b"")] * len(exits)
        ahead = pack(parts) + middle
        back = forward(cut[1], size, [0], len(t))
        return [(i, ahead + pack(walk(back, cut[1], size + j)[1])) for j in exits]


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary(path: str) -> Vocabulary:
    take_turn("pieces", _vocabulary.cache_clear)
    return _vocabulary(path)


def normal(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product; associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by halving: pairs are combined, scanned, and spread again."""
    if len(matrices) < 2:
        return matrices
    pairs = prefixes([combine(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else combine(pairs[k // 2 - 1], matrices[k]))
    return out


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, decoded: str | None = None) -> DataFrame:
    """One row per document: id and `ids`, an array of piece ids. `model` is the path of a model file on every executor.

    decoded: name of a further column, the text that the ids stand for (decode()), read back where the ids are made: a task
    needs one Python worker less, and the ids needn't be sent to it again.
    """
    short = F.coalesce(F.length(text_col), F.lit(0)) <= chunk
    more = [(decoded, "string")] if decoded else []

    def whole(raw: pa.Array) -> list[pa.Array]:
        v = vocabulary(model)
        made = [v.encode_all(raw.slice(k, ROWS))[:2] for k in range(0, len(raw), ROWS)]
        count = np.concatenate([np.empty(0, np.int64), *[c for _, c in made]])
        ids = np.concatenate([np.empty(0, np.int32), *[i for i, _ in made]])
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(ids)), *([_texts(v, ids, count)] if more else [])]

    out = with_computed(docs.where(short), [id_col], [F.col(text_col)], whole, [("ids", "array<int>"), *more])
    long = _encode_long(docs.where(~short), model, id_col, text_col, chunk)
    return out.unionByName(decode(long, model, keep=(id_col, "ids"), name=decoded) if decoded else long)


def _texts(v: Vocabulary, ids: np.ndarray, count: np.ndarray) -> pa.Array:
    """What the runs of `count` ids stand for."""
    found = v.decode(ids, count)
    try:
        return pa.array(found, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # byte pieces that are no UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in found], pa.string())


def _encode_long(docs: DataFrame, model: str, id_col: str, text_col: str, chunk: int) -> DataFrame:
    kind = docs.schema[id_col].dataType
    key = T.StructType().add("uid", "long").add("n", "integer")

    def cut(batches):
        v = vocabulary(model)
        for b in batches:
            for uid, own, text in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                t = normal(text)
                for n, at in enumerate(range(0, len(t), chunk)):
                    size = min(chunk, len(t) - at)
                    row = [[uid], [n], [own], [t[at : at + size + v.longest - 1]], [size], [at + size == len(t)]]
                    yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int32()), pa.array(row[2], b.column(1).type), pa.array(row[3]), pa.array(row[4], pa.int32()), pa.array(row[5])], names=["uid", "n", "own", "t", "size", "last"])

    schema = T.StructType([*key, T.StructField("own", kind)]).add("t", "string").add("size", "integer").add("last", "boolean")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("own"), text_col)
    # written once, so that the row numbers stay; dealt by chunk, so that a giant document is spread over tasks
    chunks = materialize(rows.mapInArrow(cut, schema).repartition("uid", "n"), "pieces-chunks")

    def per_chunk(df: DataFrame, cols: list[str], fn, field: str, dtype: str) -> DataFrame:
        return with_computed(df, ["uid", "n"], [F.col(c) for c in cols], fn, [(field, dtype)])

    def matrices(t, size):
        v = vocabulary(model)
        ts, sizes = t.to_pylist(), size.to_pylist()
        return [pa.array([v.transfer(x, s, c, m).tobytes() for x, s, (c, m, _) in zip(ts, sizes, v.middles(ts, sizes), strict=True)], pa.binary())]

    def scan(g: pa.Table) -> pa.Table:
        g = g.sort_by("n")
        v = vocabulary(model)
        shape = (v.longest, v.longest)
        ends = prefixes([np.frombuffer(x, np.int64).reshape(shape) for x in g.column("m").to_pylist()])
        first = np.full(v.longest, NONE, np.int64)
        first[0] = 0
        return pa.table({"uid": g.column("uid"), "n": g.column("n"), "alpha": pa.array([x.tobytes() for x in [first, *[e[0] for e in ends[:-1]]]], pa.binary())})

    m = per_chunk(chunks, ["t", "size"], matrices, "m", "binary")
    # as many rows as chunks: joined by sorting at every size
    alphas = materialize(m.groupBy("uid").applyInArrow(scan, T.StructType([*key]).add("alpha", "binary")), "pieces-alpha")
    entered = chunks.join(alphas.hint("merge"), ["uid", "n"])

    def entries(t, size, alpha):
        v = vocabulary(model)
        states = list(range(v.longest))
        out = []
        for x, s, a in zip(t.to_pylist(), size.to_pylist(), alpha.to_pylist(), strict=True):
            fits = [j for j in states if s + j <= len(x)]
            out.append(bytes(i if i < v.longest else 0 for i, _ in v.trace(x, s, np.frombuffer(a, np.int64), fits, v.cuts(x, s), None)))
        return [pa.array(out, pa.binary())]

    def compose(g: pa.Table) -> pa.Table:
        g = g.sort_by("n")
        state, out = 0, []
        for e in reversed(g.column("e").to_pylist()):
            out.append(state)
            state = e[state]
        return pa.table({"uid": g.column("uid"), "n": g.column("n"), "leave": pa.array(out[::-1], pa.int32())})

    e = per_chunk(entered, ["t", "size", "alpha"], entries, "e", "binary")
    exits = materialize(e.groupBy("uid").applyInArrow(compose, T.StructType([*key]).add("leave", "integer")), "pieces-exits")

    def back(t, size, alpha, leave):
        v = vocabulary(model)
        ts, sizes = t.to_pylist(), size.to_pylist()
        rest = zip(ts, sizes, alpha.to_pylist(), leave.to_pylist(), v.middles(ts, sizes), strict=True)
        found = [v.trace(x, s, np.frombuffer(a, np.int64), [j], c, m)[0][1] for x, s, a, j, (c, _, m) in rest]
        offsets = np.cumsum([0] + [len(x) // 4 for x in found])
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))]

    traced = with_computed(entered.join(exits.hint("merge"), ["uid", "n"]), ["uid", "n", "own"], [F.col(c) for c in ("t", "size", "alpha", "leave")], back, [("part", "array<int>")])
    parts = traced.groupBy("uid").agg(F.first("own").alias(id_col), F.array_sort(F.collect_list(F.struct("n", "part"))).alias("_p"))
    return parts.select(id_col, F.flatten("_p.part").alias("ids"))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids"), name: str = "decoded") -> DataFrame:
    """The `keep` columns and the text that each row's ids stand for."""

    def run(ids: pa.Array) -> list[pa.Array]:
        count = np.array([len(x) if x.is_valid else 0 for x in ids], np.int64)
        return [_texts(vocabulary(model), ids.flatten().to_numpy(), count)]

    return with_computed(encoded, list(keep), [F.col(ids_col)], run, [(name, "string")])
