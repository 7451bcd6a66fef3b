"""Token ids in binary files of patched frame-of-reference blocks.

Texts are encoded with a tokenizer file, an end id follows each document, and the stream of ids, documents in ascending id
order, is cut into blocks of `BLOCK` ids. A block stores its minimum, the ids less that minimum packed at the least width that
fits the share `FIT` of them, and the rest as exceptions: positions and whole values. A file (one `raw`) is

    magic "TLPF", version u32, documents u64, ids u64, blocks u64, bytes of names u64
    per document: number of ids u32, bytes of its name u32 (all ones: a null id); then the names: document ids as UTF-8 text
    per block: byte offset of its start u64 (the index)
    blocks: minimum u32, ids u16, width u8, exceptions u16, packed bits, positions u16 each, values u32 each

all little-endian. Any block can be read alone through the index. Spark writes the files as the rows of a Parquet table in
the shared folder (one or more for each range of document ids), so writing works on any store, is committed by task, and
survives lost executors. Beside a file stand its range, its number in it, its ids, and the ids of the range before it; the sums
of the ranges (as many as partitions) then give each file its global start.

Edge cases: null text is an empty one and has the end id alone; null ids sort first; repeated rows are each stored, in an
order fixed by their ids; equal document ids with different texts may fall into different ranges; an empty table gives no
file. Special tokens of the tokenizer that occur in a text are taken for what they are, as the library does.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm.common import gather, materialize, small_batches, take_turn

BLOCK = 1024
FIT = 0.95
_HEAD = struct.Struct("<4sIQQQQ")
_NULL = (1 << 32) - 1
_BLOCK = struct.Struct("<IHBH")


def pack(values: np.ndarray, width: int) -> bytes:
    """`values` (unsigned) at `width` bits each, least significant bit first."""
    if not width:
        return b""
    if width in (8, 16, 32):  # whole bytes: the same layout
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded.ravel(), bitorder="little").view("<u4")


def write_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    # the least width at which the share FIT of the ids fits
    lengths = np.sort(np.frexp(rest.astype(np.float64))[1])
    width = int(lengths[max(0, math.ceil(len(lengths) * FIT) - 1)])
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    values = rest[out]
    rest[out] = 0
    return _BLOCK.pack(low, len(ids), width, len(out)) + pack(rest, width) + out.astype("<u2").tobytes() + values.astype("<u4").tobytes()


def read_block(raw: bytes, at: int) -> np.ndarray:
    low, n, width, wrong = _BLOCK.unpack_from(raw, at)
    at += _BLOCK.size
    size = -(-n * width // 8)
    ids = unpack(raw[at : at + size], n, width).copy()
    at += size
    ids[np.frombuffer(raw, "<u2", wrong, at)] = np.frombuffer(raw, "<u4", wrong, at + 2 * wrong)
    return ids + np.uint32(low)


def write_image(docs: list[np.ndarray], owners: list[str | None] | None = None) -> bytes:
    """A file of these documents' ids; owners: their names."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    blocks = [write_block(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    names = [None if o is None else o.encode() for o in (owners or [None] * len(docs))]
    told = b"".join([n or b"" for n in names])
    lengths = np.array([[len(d), _NULL if n is None else len(n)] for d, n in zip(docs, names, strict=True)], "<u4")
    first = _HEAD.size + 8 * len(docs) + len(told) + 8 * len(blocks)
    starts = first + np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.empty(0)
    return b"".join([_HEAD.pack(b"TLPF", 2, len(docs), len(ids), len(blocks), len(told)), lengths.tobytes(), told, np.asarray(starts, "<u8").tobytes(), *blocks])


def _head(raw: bytes) -> tuple[int, int, int, np.ndarray, int]:
    """Ids, blocks, bytes of names, (ids, bytes of name) of each document, and where the names begin."""
    magic, version, docs, total, blocks, told = _HEAD.unpack_from(raw)
    if magic != b"TLPF" or version != 2:
        raise ValueError("not a token file of version 2")
    return total, blocks, told, np.frombuffer(raw, "<u4", 2 * docs, _HEAD.size).reshape(-1, 2), _HEAD.size + 8 * docs


def read_image(raw: bytes) -> list[np.ndarray]:
    """The ids of each document."""
    total, blocks, told, lengths, at = _head(raw)
    starts = np.frombuffer(raw, "<u8", blocks, at + told)
    ids = np.concatenate([read_block(raw, int(s)) for s in starts]) if blocks else np.empty(0, np.uint32)
    if len(ids) != total or int(lengths[:, 0].sum()) != total:
        raise ValueError("token file is cut short")
    return np.split(ids, np.cumsum(lengths[:, 0])[:-1]) if len(lengths) else []


def read_owners(raw: bytes) -> list[str | None]:
    """The names of the documents."""
    _, _, told, lengths, at = _head(raw)
    names, sizes = raw[at : at + told], lengths[:, 1].astype(np.int64)
    ends = np.cumsum(np.where(sizes == _NULL, 0, sizes)).tolist()
    return [None if n == _NULL else names[i:j].decode() for i, j, n in zip([0, *ends[:-1]], ends, sizes.tolist(), strict=False)]


def latin(word: str) -> bool:
    """Whether a word is of Latin letters alone, which all versions of Unicode agree on."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class Encoder:
    """A tokenizer, remembering the ids of words between single blanks (their pre-tokens never cross such a blank)."""

    #: a blank between other white space or at the end next to it: what the pre-tokenizer does there needs the context
    odd = re.compile(r"\s (?:\s|\Z)")
    edge = re.compile(r"(?<=[^\W_])(?=[.,])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
    #: words remembered in a generation
    size = 400_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        #: whether this tokenizer is of the kind whose words can be taken alone
        self.splits = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: ids of a blank and a word; when full it becomes `before`, from which words still in use come back
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # the characters that the byte level stands for bytes with: printing ones for themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.shown = np.zeros(256, "<u2")
        self.shown[plain], self.shown[other] = plain, 256 + np.arange(len(other))
        # letters alone are one pre-token: they go to the same model without its pattern, with line ends between
        self.line = chr(int(self.shown[10]))
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = pre_tokenizers.Split(self.line, "isolated")
        self.end = self.ids(["\n"])[0]
        self.mark = dict(zip(".,", self.ids([".", ","]), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, p: str) -> list[str]:
        """Parts that can be taken alone; the usual word, with or without one mark at its end, is settled without the pattern."""
        if p[1:].isalpha() and p[0] == " ":
            return [p]
        if p[-1:] in (".", ",") and p[1:-1].isalpha() and p[0] == " ":
            return [p[:-1], p[-1]]
        return self.edge.split(p)

    def needs_context(self, t: str) -> bool:
        """Whether a special token or `odd` is found; plain ASCII text is settled without the pattern."""
        if any(x in t for x in self.special):
            return True
        if t.isascii() and "  " not in t and "\n " not in t and not t.endswith(" ") and not any(c in t for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
            return False
        return self.odd.search(t) is not None

    def many(self, texts: list[str], tokenizer, line: str) -> list[bytes]:
        """Ids of texts that the pre-tokenizer cuts off at line ends, thousands of them in one text."""
        out = []
        for k in range(0, len(texts), 4000):
            part = texts[k : k + 4000]
            joined = "\n".join(part)
            if line != "\n":
                joined = self.shown[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == np.frombuffer(self.end, "<u4")[0])
            raw = ids.tobytes()
            out += [raw[4 * i : 4 * j] for i, j in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True)]
        return out

    def words(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word."""
        if len(self.end) != 4:
            return dict(zip(texts, self.ids(texts), strict=True))
        alone = [t for t in texts if latin(t[1:] if t[:1] == " " else t)]
        out = dict(zip(alone, self.many(alone, self.letters, self.line), strict=True))
        plain = [t for t in texts if t not in out and t.strip() and not t[-1].isspace() and "\n" not in t and not (t[1:2] if t[0] == " " else t[0]).isspace()]
        out.update(zip(plain, self.many(plain, self.tokenizer, "\n"), strict=True))
        rest = [t for t in texts if t not in out]
        out.update(zip(rest, self.ids(rest), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, count = self.encode_all(pa.array(texts, pa.string()))
        ends = np.r_[0, np.cumsum(count)].tolist()
        return [ids[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has. No null texts."""
        told = texts.to_pylist()
        alone = np.array([not self.splits or self.needs_context(t) for t in told], bool)
        split = pc.split_pattern(texts.filter(pa.array(~alone)), " ")
        coded = split.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at, sizes = coded.indices.to_numpy().copy(), split.value_lengths().to_numpy().astype(np.int64)
        # first words have no blank in front and are not remembered
        begin = np.cumsum(sizes) - sizes
        first = [own[k] for k in at[begin]]
        found = self.remembered(own, first) + self.ids([t for t, x in zip(told, alone, strict=True) if x])
        at[begin] = len(own) + np.arange(len(first))
        at = np.r_[at, np.arange(len(own) + len(first), len(found))]
        sizes = np.r_[sizes, np.ones(int(alone.sum()), np.int64)]
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        ends = np.r_[0, np.cumsum(count[at])][np.r_[0, np.cumsum(sizes)]]
        ids = gather(flat, (np.cumsum(count) - count)[at], count[at])
        if not alone.any():
            return ids, np.diff(ends)
        place = np.argsort(np.argsort(alone, kind="stable"), kind="stable")
        begin, count = ends[:-1][place], np.diff(ends)[place]
        return gather(ids, begin, count), count

    def remembered(self, own: list[str], first: list[str]) -> list[bytes]:
        """Ids of a blank and each of the `own` words, then of each of the `first` ones as it is."""
        if len(self.known) > self.size:  # bounded, so that a task's memory does not follow its input
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, own))
        # letters alone, maybe with one mark at the end; and words of other kinds
        bare, marked, other = [], [], []
        for k in [k for k, x in enumerate(found) if x is None]:
            w = own[k]
            if (x := before.get(w)) is not None:
                known[w] = found[k] = x
            elif latin(w):
                bare.append(k)
            elif w[-1:] in (".", ",") and latin(w[:-1]):
                marked.append(k)
            else:
                other.append(k)
        stems = [own[k][:-1] for k in marked]
        new = list({*(own[k] for k in bare), *(w for w in stems if w not in known)})
        fresh = self.many([" " + w for w in new], self.letters, self.line) if len(self.end) == 4 else self.ids([" " + w for w in new])
        known.update(zip(new, fresh, strict=True))
        for k in bare:
            found[k] = known[own[k]]
        for k, w in zip(marked, stems, strict=True):
            known[own[k]] = found[k] = known[w] + self.mark[own[k][-1]]
        pieces = [self.cut(p) for p in [*(" " + own[k] for k in other), *first]]
        small = set(chain.from_iterable(pieces))
        fresh = {q: known[q[1:]] for q in small if q[:1] == " " and q[1:] in known}
        fresh.update(self.words(list(small.difference(fresh))))
        made = [b"".join([fresh[q] for q in parts]) for parts in pieces]
        for k, x in zip(other, made, strict=False):
            known[own[k]] = found[k] = x
        for k in (*bare, *marked, *other):
            if len(own[k]) > 48:
                known.pop(own[k], None)
        return found + made[len(other) :]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    take_turn("token_file", _encoder.cache_clear)
    return _encoder(path)


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, image_ids: int = 4_000_000) -> DataFrame:
    """Encode and write all documents; returns the written table: `range`, `image` (number within its range), `before`, `ids`, `raw`.

    partitions: number of ranges of document ids (default: as many as shuffle partitions). A range is sorted, so a file
    holds ascending ids, and a range with more than `image_ids` ids is stored as several files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    order = ["own", F.crc32(F.col("t").cast("binary")), F.length("t")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.col("own").cast("string").alias("own"), "t", F.spark_partition_id().alias("range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        held: list[np.ndarray] = []
        owners: list[str | None] = []
        image = where = before = size = 0

        def out():
            nonlocal held, owners, image, before, size
            row = [pa.array([where], pa.int32()), pa.array([image], pa.int32()), pa.array([before]), pa.array([size]), pa.array([write_image(held, owners)], pa.binary())]
            held, owners, image, before, size = [], [], image + 1, before + size, 0
            return pa.RecordBatch.from_arrays(row, names=["range", "image", "before", "ids", "raw"])

        for b in batches:
            if b.num_rows:
                where = b.column(2)[0].as_py()
                ids, count = e.encode_all(b.column(1))
                ends = np.cumsum(count)
                ids, ends = np.insert(ids, ends, end_id), (ends + np.arange(1, len(ends) + 1)).tolist()
                for own, i, j in zip(b.column(0).to_pylist(), [0, *ends], ends, strict=False):
                    held.append(ids[i:j])
                    owners.append(own)
                    size += j - i
                    if size >= image_ids:
                        yield out()
        if held:
            yield out()

    schema = T.StructType().add("range", "integer").add("image", "integer").add("before", "long").add("ids", "long").add("raw", "binary")
    return materialize(dealt.mapInArrow(run, schema), "token-file")


def read(written: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """One row per stored document: id, `start` (ids of all before it), `n_tokens`, `ids_crc32` over its ids' bytes."""
    spark = written.sparkSession
    sums = {r["range"]: r["n"] for r in written.groupBy("range").agg(F.sum("ids").alias("n")).collect()}  # as many as partitions
    begin = np.cumsum([0, *[sums[k] for k in sorted(sums)]]).tolist()
    base = spark.sparkContext.broadcast(dict(zip(sorted(sums), begin, strict=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, before, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = raw.as_py()
                docs = read_image(raw)
                n = np.array([len(d) for d in docs], np.int64)
                start = base.value[where] + before + np.cumsum(n) - n
                crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array(read_owners(raw), pa.string()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], names=["own", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType().add("own", "string").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    return written.select("range", "before", "raw").mapInArrow(run, schema).select(F.col("own").cast(id_type).alias(id_col), "start", "n_tokens", "ids_crc32")
