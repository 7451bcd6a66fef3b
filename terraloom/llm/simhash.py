"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

A document's fingerprint is a majority vote, bit by bit, over the XXH64 hashes of its word shingles. Two fingerprints
link when they differ in few bits; the classes are the connected components of those links.

The join walks pairs of trie nodes from the root, carries the number of bits in which the two prefixes differ, and drops
a pair as soon as that exceeds its budget. Three things keep it near-linear:

* Budgets by position. The 64 bits form `bits + 1` segments. If all segments together differ in at most `bits` bits,
  then some rotation of the segments has at most `i * bits / (bits + 1)` differing bits in its first i segments, for
  every i (cycle lemma). So the walk is made once for each rotation, with that budget for each prefix; the first
  segment must even be equal, which deals the walk out to tasks by that segment.
* Only distinct fingerprints take part, and budgets are walked in rising order; a node pair whose leaves are already in
  one component is dropped. A dense ball of near copies thus costs about its size and not its square.
* A first segment that very many fingerprints share is split into node pairs further down, each a unit of its own.

Similarity joins (similar()). One word of 64 bits tells similarities near 1 apart from the rest; to link at a lower one, every
shingle votes on several such words. Tries are walked over the first of them, and pairs whose words differ in few bits in all
are candidates, which are then tested on the whole shingle sets.

Edge cases: null text, or one without words, has fingerprint zero and links like any other; repeated rows stay; null ids
are kept and never name a component unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import materialize, take_turn, with_computed

WIDTH = 64
#: rows of whole units that a task takes at a time
HELD = 30_000
#: bit i of a byte value, as a 256 x 8 table
_SLOT = np.arange(8, dtype=np.int16) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(raw: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, in its order; a shorter text is one shingle, one without words has none."""
    parts = raw.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    text = b" ".join(parts)
    if len(parts) <= shingle:
        return np.array([xxhash.xxh64_intdigest(text, seed)], dtype=np.uint64)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    begin = (end - length)[: len(parts) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[i:j], seed) for i, j in zip(begin, end[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def sketch(raw: bytes, shingle: int, words: int = 1, seed: int = 42) -> bytes:
    """Fingerprint of one text as `words` big-endian unsigned 64-bit words; the first is the plain SimHash.

    A-Z is lower-cased, words split at ASCII white space, shingles count as often as they occur.
    """
    return votes(shingle_hashes(raw, shingle, seed), words)


def votes(hashes: np.ndarray, words: int = 1) -> bytes:
    """Fingerprint of shingle hashes, by majority of each bit."""
    if not len(hashes):
        return bytes(8 * words)
    out = []
    for w in range(words):
        mixed = hashes
        if w:  # an independent hash from the first one
            mixed = hashes + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            mixed = mixed ^ (mixed >> np.uint64(32))
        octets = mixed.view(np.uint8).reshape(-1, 8).astype(np.int16) + _SLOT
        counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out.append(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes()[::-1])
    return b"".join(out)


def parities(hashes: np.ndarray) -> bytes:
    """1024 bits of a set of hashes: whether an odd number of them falls on each (odd sketch). Two sets differ in at least as many elements as these in bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).tobytes()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per document: its id and `sketch`, its fingerprint as bytes."""

    def run(raw: pa.Array) -> list[pa.Array]:
        take_turn("simhash", lambda: None)
        return [pa.array([sketch(x or b"", shingle) for x in raw.to_pylist()], pa.binary())]

    return with_computed(docs, [id_col], [text_col], run, [("sketch", "binary")])


def word(col, at: int):
    """Word `at` of a sketch, as a signed long."""
    return F.conv(F.hex(F.substring(col, 8 * at + 1, 8)), 16, -10).cast("long")


def segments(bits: int) -> list[int]:
    """Lengths of the `bits + 1` segments of a fingerprint."""
    m = bits + 1
    return [WIDTH // m + (i < WIDTH % m) for i in range(m)]


def budgets(bits: int, rotation: int, total: int) -> list[int]:
    """For each depth 0..64, how many bits may differ above it in this rotation when `total` may differ at all."""
    lengths = segments(bits)
    turned = lengths[rotation:] + lengths[:rotation]
    out = [0]
    for i, n in enumerate(turned, 1):
        out += [i * total // len(turned)] * n
    return out


class _Labels:
    """Components of fingerprints, by the least index of each."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.change = np.r_[0, np.cumsum(label[1:] != label[:-1])]

    def merge(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Join the components of i and j; returns which of the pairs make up a spanning forest of what is new."""
        label, used = self.label, []
        at = np.arange(len(i))
        while True:
            a, b = label[i[at]], label[j[at]]
            at, low, high = at[a != b], np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            if not len(at):
                break
            order = np.lexsort((low, high))
            first = order[np.r_[True, np.diff(high[order]) > 0]]  # one pair for each greater label, to a lesser one
            used.append(at[first])
            label[high[first]] = low[first]
            while not np.array_equal(label, nxt := label[label]):
                label[:] = nxt
        if used:
            self.change = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        return np.concatenate(used) if used else np.empty(0, np.int64)

    def pure(self, s, e, t, f) -> np.ndarray:
        """Node pairs whose leaves are all in one component."""
        label, change = self.label, self.change
        return (change[e - 1] == change[s]) & (change[f - 1] == change[t]) & (label[s] == label[t])


def _expand(left: tuple, right: tuple, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the given ranges (each pair once where both ranges are one and the same)."""
    (s, e), (t, f) = left, right
    n, m = e - s, f - t
    each = n * m
    which = np.repeat(np.arange(len(s)), each)
    k = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    i, j = s[which] + k // m[which], t[which] + k % m[which]
    keep = (i < j) | ~same[which]
    return i[keep], j[keep]


def _equal(labels: _Labels, s: int, e: int, t: int, f: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a range with itself, or of two ranges, in different components: one leaf with all others at a time.

    Of leaves that lie close together, the first one's turn joins all, and no other is compared.
    """
    own = (s, e) == (t, f)
    for i in range(s, e):
        if bool(labels.pure(*(np.array([x]) for x in (s, e, t, f)))[0]):
            return
        j = np.arange(i + 1 if own else t, f)
        j = j[labels.label[j] != labels.label[i]]
        if len(j):
            yield np.full(len(j), i), j


def _leaves(turned: np.ndarray, bounds: np.ndarray, rotation: np.ndarray, bits: int, total: int, labels: _Labels, chunk: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at which the walk within budget `total` ends; what `labels` joins meanwhile is not walked any more.

    Node pairs wait on a stack in blocks of at most `chunk`, deepest first, so memory stays bounded.
    """
    allowed = np.array([budgets(bits, r, total) for r in range(bits + 1)])
    first = min(segments(bits))
    zeros = {}
    roots = np.flatnonzero(np.diff(bounds) > 1)
    s, e = bounds[:-1][roots], bounds[1:][roots]
    stack = [(first, s[k : k + chunk], e[k : k + chunk], s[k : k + chunk], e[k : k + chunk], np.zeros(len(s[k : k + chunk]), np.int64)) for k in range(0, len(s), chunk)]
    while stack:
        depth, s, e, t, f, acc = stack.pop()
        keep = ~labels.pure(s, e, t, f)
        s, e, t, f, acc = (x[keep] for x in (s, e, t, f, acc))
        if not len(s):
            continue
        small = (e - s) * (f - t) <= leaf
        if small.any():
            yield _expand((s[small], e[small]), (t[small], f[small]), ((s == t) & (e == f))[small])
            s, e, t, f, acc = (x[~small] for x in (s, e, t, f, acc))
            if not len(s):
                continue
        if depth == WIDTH:  # equal leaves on either side
            for node in zip(s.tolist(), e.tolist(), t.tolist(), f.tolist(), strict=True):
                yield from _equal(labels, *node)
            continue
        if depth not in zeros:
            zeros[depth] = np.r_[0, np.cumsum((turned >> np.uint64(WIDTH - 1 - depth)) & np.uint64(1) == 0)].astype(np.int32)
        z = zeros[depth]
        u, v = s + z[e] - z[s], t + z[f] - z[t]
        cross = (s != t) | (e != f)
        parts = [(s, u, t, v, acc, None), (u, e, v, f, acc, None), (s, u, v, f, acc + 1, None), (u, e, t, v, acc + 1, cross)]
        most = allowed[rotation[s], depth + 1]
        out = []
        for a, b, c, d, more, only in parts:
            ok = (a < b) & (c < d) & (more <= most)
            ok &= ~((a == c) & (b == d) & (b - a == 1))
            if only is not None:
                ok &= only
            out.append([x[ok] for x in (a, b, c, d, more)])
        s, e, t, f, acc = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(acc, kind="stable")[::-1]  # equal prefixes last, so that they are taken first
        s, e, t, f, acc = (x[order] for x in (s, e, t, f, acc))
        stack += [(depth + 1, s[k : k + chunk], e[k : k + chunk], t[k : k + chunk], f[k : k + chunk], acc[k : k + chunk]) for k in range(0, len(s), chunk)]


def _bounds(unit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])


def trie_components(turned: np.ndarray, unit: np.ndarray, rotation: np.ndarray, bits: int, chunk: int = 1 << 16, leaf: int = 8) -> np.ndarray:
    """Label of each fingerprint's component among those of its unit.

    `turned`: rotated fingerprints, sorted inside runs of equal `unit`; members of a unit share the first segment.
    """
    labels = _Labels(np.arange(len(turned)))
    for total in sorted({min(bits, 1 << k) for k in range(bits.bit_length() + 1)}):
        for i, j in _leaves(turned, _bounds(unit), rotation, bits, total, labels, chunk, leaf):
            near = np.bitwise_count(turned[i] ^ turned[j]) <= total
            labels.merge(i[near], j[near])
    return labels.label


def trie_candidates(turned: np.ndarray, unit: np.ndarray, rotation: np.ndarray, bits: int, wide: np.ndarray, label: np.ndarray, trie: np.ndarray, total: int, safe: int, least: int, chunk: int = 1 << 16, leaf: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that trie_pairs() finds, at once."""
    found = [np.empty((3, 0), np.int64), *map(np.stack, trie_pairs(turned, unit, rotation, bits, wide, label, trie, total, safe, least, chunk, leaf))]
    return tuple(np.concatenate(found, axis=1))


def trie_pairs(turned, unit, rotation, bits, wide, label, trie, total, safe, least, chunk: int = 1 << 16, leaf: int = 8, mark: bool = True, may=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) worth a test, and in how many bits all words differ.

    label: components known so far, whose pairs need no test. Without `safe`: all pairs that differ in more than `least` and at most
    `total` bits. With it: sketches that differ in at most `safe` bits are taken for linked meanwhile, the closest first, and of them a
    spanning forest is returned; with `mark`, each sketch that has then another one within `total` bits is returned as a pair with itself. trie:
    the word that each fingerprint is; a pair that the walk over an earlier word finds too is left to that one. may: tells of pairs (i, j) whether
    they can link at all; those that can't are neither returned nor taken for linked.
    """
    _, first, which = np.unique(label, return_index=True, return_inverse=True)
    labels = _Labels(first[which])

    def apart(i, j):
        each = np.bitwise_count(wide[i] ^ wide[j])
        earlier = (each <= bits) & (np.arange(each.shape[1]) < trie[i][:, None])
        return each.sum(axis=1, dtype=np.int64), ~earlier.any(axis=1)

    for allowed in sorted({min(bits, 1 << k) for k in range(bits.bit_length() + 1)}) if safe else []:
        for i, j in _leaves(turned, _bounds(unit), rotation, bits, allowed, labels, chunk, leaf):
            d, own = apart(i, j)
            near = np.flatnonzero(d <= safe)
            near = near if may is None else near[may(i[near], j[near])]
            i, j, d, own = i[near], j[near], d[near], own[near]
            order = np.argsort(d, kind="stable")
            i, j, d, own = i[order], j[order], d[order], own[order]
            used = labels.merge(i, j)
            used = used[own[used]]
            yield i[used], j[used], d[used]
    if safe and not mark:
        return
    some = np.zeros(len(turned), bool)
    for i, j in _leaves(turned, _bounds(unit), rotation, bits, bits, labels, chunk, leaf):
        d, own = apart(i, j)
        near = np.flatnonzero((d > least) & (d <= total) & own & (labels.label[i] != labels.label[j]))
        near = near if may is None else near[may(i[near], j[near])]
        if safe:
            some[i[near]] = some[j[near]] = True
        else:
            yield i[near], j[near], d[near]
    at = np.flatnonzero(some)
    yield at, at, np.full(len(at), total)


def _turn(fp: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return (fp << by) | np.where(by > 0, fp >> ((np.uint64(WIDTH) - by) & np.uint64(63)), np.uint64(0))


def _units(prints: DataFrame, bits: int, unit_rows: int, step: int, tries: int) -> tuple[DataFrame, list[str]]:
    """Each sketch once for every rotation of its first words, in units (key columns) whose node pairs are to be walked.

    unit_rows: a node pair with more fingerprints than this is split `step` bits further down, again and again.
    """
    lengths = segments(bits)
    offsets = [sum(lengths[:r]) for r in range(bits + 1)]
    first = min(lengths)

    def prefix(depth: int):
        return F.expr(f"shiftrightunsigned(shiftleft(fp, off) | if(off > 0, shiftrightunsigned(fp, 64 - off), 0L), {64 - depth})")

    own = prints.columns
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), F.lit(r).alias("rot"), F.lit(o).alias("off"), word("sketch", t).alias("fp")) for t in range(tries) for r, o in enumerate(offsets)]))
    units = prints.select(*own, turns.alias("_t")).select(*own, "_t.*")
    units = units.select(*own, "fp", "trie", "rot", "off", prefix(first).alias("p"), prefix(first).alias("q"), F.lit(first).alias("depth"))
    key, done = ["trie", "rot", "depth", "p", "q"], []
    depth = first
    while depth + step < WIDTH:
        hot = units.groupBy(*key).count().where(F.col("count") > unit_rows).select(*key)
        if not hot.take(1):
            break
        hot = materialize(hot, "simhash-hot")
        done.append(units.join(hot, key, "left_anti"))
        units = units.join(hot, key, "left_semi")
        depth += step
        limit = F.element_at(F.array(*[F.lit(budgets(bits, r, bits)[depth]) for r in range(bits + 1)]), F.col("rot") + 1)
        masks = F.array(*[F.lit(m).cast("long") for m in range(1 << step) if m.bit_count() <= bits])
        units = units.withColumn("_m", F.explode(masks)).withColumn("_n", prefix(depth))
        units = units.withColumn("_d", F.shiftleft(F.col("p").bitwiseXOR(F.col("q")), step).bitwiseXOR(F.col("_m"))).where(F.bit_count("_d") <= limit)
        other = F.col("_n").bitwiseXOR(F.col("_d"))
        units = units.select(*own, "fp", "trie", "rot", "off", F.least("_n", other).alias("p"), F.greatest("_n", other).alias("q"), F.lit(depth).alias("depth"))
        units = materialize(units, "simhash-units")
    for x in done:
        units = units.unionByName(x)
    return units, key


def _by_unit(units: DataFrame, key: list[str], columns: list[str], fn, schema: str) -> DataFrame:
    """fn(table, columns as arrays, order, turned fingerprints, units, rotations) for runs of whole units, sorted by fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            t = pa.Table.from_batches(held)
            cols = [t.column(k).to_numpy() for k in (*key, "off", "fp")]
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:5]], axis=0)) + 1
            if not last:  # the last unit may go on in the next batch
                if not len(edge):
                    return
                held = t.slice(edge[-1]).to_batches()
                t = t.slice(0, edge[-1])
                cols = [c[: edge[-1]] for c in cols]
                edge = edge[:-1]
            else:
                held = []
            rot, off, fp = cols[1], *cols[5:]
            unit = np.zeros(len(fp), np.int64)
            unit[edge] = 1
            unit = np.cumsum(unit)
            turned = _turn(fp.view(np.uint64), off)
            order = np.lexsort((turned, unit))
            yield from fn(t, order, turned[order], unit[order], rot[order])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= HELD:
                yield from flush(False)
        yield from flush(True)

    dealt = units.repartition(*key).sortWithinPartitions(*key)
    return dealt.select(*key, "off", "fp", *columns).mapInArrow(run, schema)


def links(prints: DataFrame, bits: int = 4, unit_rows: int = 200_000, step: int = 6) -> DataFrame:
    """Links (a, b) of `node`s, whose components are those of all pairs of fingerprints that link (see above).

    prints: a row per distinct fingerprint: `node` long, `sketch` binary.
    """
    units, key = _units(prints, bits, unit_rows, step, 1)

    def run(t: pa.Table, order, turned, unit, rot) -> Iterator[pa.RecordBatch]:
        node = t.column("node").to_numpy()[order]
        label = trie_components(turned, unit, rot, bits)
        found = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(node[label[found]])], names=["a", "b"])

    return _by_unit(units, key, ["node"], run, "a long, b long")


def candidates(prints: DataFrame, bits: int, words: int, tries: int, total: int, safe: int, least: int, unit_rows: int = 200_000, step: int = 6, mark: bool = True, num: int = 0, den: int = 1) -> DataFrame:
    """Pairs a <= b of `node`s worth a test (trie_pairs()), each once.

    prints: a row per sketch: `node` long, `label` long (a component known so far), `sketch` binary. With `odd` (parities() of a set) and `size` (its
    elements) too, pairs whose sets surely have a Jaccard similarity below num / den are left out: at that similarity they differ in
    (den - num) / (den + num) of their elements, and in no more bits of `odd`.
    """
    more = [c for c in ("odd", "size") if c in prints.columns]
    units, key = _units(prints, bits, unit_rows, step, tries)

    def run(t: pa.Table, order, turned, unit, rot) -> Iterator[pa.RecordBatch]:
        node, label = t.column("node").to_numpy()[order], t.column("label").to_numpy()[order]
        wide = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, words)[order]
        may = None
        if more:
            odd = np.frombuffer(b"".join(t.column("odd").to_pylist()), np.uint64).reshape(-1, 16)[order]
            size = t.column("size").to_numpy()[order]
            may = lambda i, j: (den + num) * np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64) <= (den - num) * (size[i] + size[j])
        # a sketch may be in several units of a batch
        held, n = [], 0
        for i, j, _ in trie_pairs(turned, unit, rot, bits, wide, _dense(label, unit), t.column("trie").to_numpy()[order], total, safe, least, mark=mark, may=may):
            held.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
            n += len(i)
            if n > 1 << 17:
                yield pairs(held)
                held, n = [], 0
        if held:
            yield pairs(held)

    def pairs(held) -> pa.RecordBatch:
        found = np.unique(np.concatenate(held, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return _by_unit(units, key, ["node", "label", "sketch", *more], run, "a long, b long").distinct()


def _dense(label: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Labels that no two units share."""
    return np.unique(np.stack([unit, label]), axis=1, return_inverse=True)[1].reshape(-1)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b) of longs: one row (`node`, `label`) per linked node, label the least node.

    Alternates large-star and small-star. A node's least neighbour comes from an aggregate with map-side sums and is
    joined back to the links, so a node with very many links is spread over tasks by adaptive skew handling.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, unit_rows: int = 200_000) -> DataFrame:
    """One row per input row: id, `fingerprint` (16 hex digits), `component_id` (least id of its component)."""
    own = sketches(docs, id_col, text_col, shingle)
    own = materialize(own.withColumn("node", word("sketch", 0)), "simhash-own")  # a node is named by its fingerprint
    per = materialize(own.groupBy("node").agg(F.min(id_col).alias("_least"), F.min("sketch").alias("sketch")), "simhash-distinct")
    of = materialize(components(links(per.select("node", "sketch"), bits, unit_rows)), "simhash-of")
    joined = per.join(of, "node", "left").select("node", "_least", F.coalesce("label", "node").alias("label"))
    joined = materialize(joined, "simhash-labelled")
    least = materialize(joined.groupBy("label").agg(F.min("_least").alias("component_id")), "simhash-least")
    named = materialize(joined.select("node", "label").join(least, "label").select("node", "component_id"), "simhash-named")
    digits = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return own.withColumn("fingerprint", digits).select(id_col, "node", "fingerprint").join(named, "node").select(id_col, "fingerprint", "component_id")


def alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least num / den."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def similar(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5, words: int = 8, tries: int = 4, bits: int = 9, forests: tuple[int, ...] = (48, 60, 72), bands: tuple[int, ...] = (72, 86, 100), unit_rows: int = 200_000) -> DataFrame:
    """One row per input row: id (a long, each once, none null) and `component_id`, the least id of its component.

    Two texts link when the Jaccard similarity of their sets of shingles is at least num / den, tested on the whole sets. Only
    candidates are tested: sketches of `words` words that differ in at most bands[-1] bits, and of whose first `tries` words one
    in at most `bits` bits. At a similarity of 0.8 they differ in 77 bits on average, and about 97 % of such pairs are candidates.

    Tests go by rounds, from the nearest candidates to the farthest. The first ones take a spanning forest of those within forests[k] bits,
    so that texts that are alike come together by few tests; then each takes all candidates up to bands[k] bits whose texts
    aren't in one component yet. There, pairs whose sets differ in too many elements by their parities are no candidates; that loses no link.
    No text has a limit to its candidates. Distinct sets take part, named by their least id; texts without words have the empty set, and link to each other.
    """

    def own(raw: pa.Array) -> list[pa.Array]:
        take_turn("simhash", lambda: None)
        sets = [np.unique(shingle_hashes(x or b"", shingle)) for x in raw.to_pylist()]
        return [pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([votes(x, words) for x in sets], pa.binary())]

    rows = materialize(with_computed(docs, [id_col], [text_col], own, [("key", "binary"), ("sketch", "binary")]), "similar-own")
    per = materialize(rows.groupBy("key").agg(F.min(id_col).alias("node"), F.min("sketch").alias("sketch")), "similar-distinct")
    found = materialize(candidates(per.select("node", F.col("node").alias("label"), "sketch"), bits, words, tries, bands[-1], forests[0], -1, unit_rows), "similar-pairs")
    # only texts with a candidate are looked at any more
    nodes = materialize(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-nodes")
    raw = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("_raw")).join(nodes, "node")

    def sets(raw: pa.Array) -> list[pa.Array]:
        found = [np.unique(shingle_hashes(x or b"", shingle)) for x in raw.to_pylist()]
        return [pa.array([x.tobytes() for x in found], pa.binary()), pa.array([parities(x) for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())]

    texts = materialize(with_computed(raw, ["node"], ["_raw"], sets, [("own", "binary"), ("odd", "binary"), ("size", "long")]), "similar-sets")
    near = materialize(per.join(texts.select("node", "odd", "size"), "node").select("node", "sketch", "odd", "size"), "similar-prints")
    links_ = labels = None
    least = -1
    for k, total in enumerate((*forests, *bands)):
        if k:
            prints = near.withColumn("label", F.col("node")) if labels is None else near.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "sketch", "odd", "size")
            forest = k < len(forests)
            prints = prints.drop("odd", "size") if forest else prints  # a forest has few pairs as it is
            found = materialize(candidates(prints, bits, words, tries, total, total if forest else 0, least, unit_rows, mark=False, num=num, den=den), "similar-pairs")
            least = least if forest else total
        held = _confirmed(found.where("a < b"), texts, num, den)
        if held.take(1):
            links_ = held if links_ is None else links_.unionByName(held)
            labels = materialize(components(links_), "similar-of")
    if labels is None:
        return rows.join(per.select("key", F.col("node").alias("component_id")), "key").select(id_col, "component_id")
    named = materialize(per.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("component_id")), "similar-named")
    return rows.select(id_col, "key").join(named, "key").select(id_col, "component_id")


def _confirmed(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets (node, own) are similar enough."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("own").alias("_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("own").alias("_b")), "b")

    def run(a: pa.Array, b: pa.Array) -> list[pa.Array]:
        take_turn("simhash", lambda: None)
        turn = lambda x: np.frombuffer(x, np.uint64)
        return [pa.array([alike(turn(x.as_py()), turn(y.as_py()), num, den) for x, y in zip(a, b, strict=True)], pa.bool_())]

    return materialize(with_computed(sides, ["a", "b"], ["_a", "_b"], run, [("ok", "boolean")], only=0), "similar-links")
