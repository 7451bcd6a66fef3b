import random

import numpy as np
import public_tokenizers
import sentencepiece

from terraloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def unigram_model(v):
    """The same pieces as a unigram model file with this vocabulary's whole-number scores, written field by field."""
    raw, at, out = open(MODEL, "rb").read(), 0, b""

    def number(at):
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if not raw[at - 1] & 128:
                return n, at

    while at < len(raw):
        tag, at = number(at)
        size, at = number(at)
        body, at = raw[at : at + size], at + size
        if tag == 10:  # a piece: text (field 1), score (field 2, float), type (field 3)
            n = body[1]
            text = body[2 : 2 + n].decode()
            kind = body[2 + n + 5 :]
            body = body[: 2 + n] + b"\x15" + np.float32(v.score.get(text, 0) if not kind or kind[-1] == 1 else 0).tobytes() + kind
        if tag == 18:  # the trainer's settings: model type (field 3) becomes unigram (1)
            body += b"\x18\x01"
        out += varint(tag) + varint(len(body)) + body
    return out


def texts():
    rng = random.Random(11)
    parts = ["the", "ing", " ", "  ", "ñ", "日", "a", "\n", "tion", "    ", "xxxxxxxxx", "€", "🙂"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]


def test_against_the_library_as_a_unigram_model():
    v = pieces.Vocabulary(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(v))
    for t in texts():
        assert np.frombuffer(v.encode(t), np.int32).tolist() == sp.encode(t), t


def test_chunks_against_serial(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:120])] + [(500, None), (501, ""), (7, "again"), (None, "the " * 40), (502, "x" * 200), (503, "the tion " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    v = pieces.Vocabulary(MODEL)
    for chunk in (17, 40):
        got = pieces.decode(pieces.encode(df, MODEL, chunk=chunk), MODEL).collect()
        want = sorted((str(i), np.frombuffer(v.encode(t), np.int32).tolist(), t or "") for i, t in rows)
        assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == want
        once = pieces.encode(df, MODEL, chunk=chunk, decoded="back").collect()
        assert sorted((str(r.doc_id), r.ids, r.back) for r in once) == want
    assert pieces.encode(df.limit(0), MODEL).count() == 0
