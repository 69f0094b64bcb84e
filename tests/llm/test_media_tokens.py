"""AVI round trips, and token counts against the tokenizer itself."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundtrace.llm import media, token_counts


@pytest.fixture(scope="module")
def own():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return token_counts.processor(file.read())


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 2048, 2049, 64 * 200 + 7])
def test_avi_round_trip(size):
    payload = media.padded(random.Random(size).randbytes(size))
    stored = media.write_avi(payload)
    assert media.read_avi(stored).payload == payload and len(payload) % 64 == 0 and len(payload) >= max(64, size)
    assert struct.unpack_from("<I", stored, 4)[0] == len(stored) - 8


def test_sequential_decoder_agrees(monkeypatch):
    stored = media.write_avi(random.Random(1).randbytes(64 * 70))
    fast = media.read_avi(stored)
    monkeypatch.setattr(media, "_flat_levels", lambda *_: None)
    assert (media.read_avi(stored).levels == fast.levels).all()


def test_sequential_decoder_reads_ac_coefficients():
    """A block with one cosine, coded by hand: DC 0 and coefficient 1 of 40."""
    dc, ac = media._table({0: 1}), media._table({0: 1, 6: 2})
    bits = "0" + "10" + f"{40:06b}" + "0"
    body = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([1] * 64)) + media._segment(0xC0, struct.pack(">BHHB3B", 8, 8, 8, 1, 1, 0x11, 0))
    head += media._segment(0xC4, b"\x00" + b"".join(dc)) + media._segment(0xC4, b"\x10" + b"".join(ac)) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    image = head + body + b"\xff\xd9"
    x = np.arange(8)
    row = 128 + 40 * 0.25 * 0.5**0.5 * np.cos((2 * x + 1) * np.pi / 16)
    assert (media._sequential(image, media.parse_jpeg(head)) == np.rint(np.tile(row, (8, 1)))).all()


def test_shots():
    rng = np.random.default_rng(2)
    dark, light = rng.integers(0, 60, (6, 256)), rng.integers(180, 250, (5, 256))
    found = media.clips(media.Video(40_000, np.concatenate([dark, light]).astype(np.uint8), b""))
    assert [(a, b) for a, b, _ in found] == [(0, 240), (240, 440)] and found[1][2] == 1.0
    assert len(media.clips(media.Video(40_000, np.zeros((1, 64), np.uint8), b""))) == 1


def shots(*lengths):
    """The clips' first frames of dark and light shots in turn; neighbouring frames of a shot differ by 0.05."""
    frames, dark = [], True
    for n in lengths:
        for i in range(n):
            frame = np.full(320, 20 if dark else 220)
            frame[:16] += 8 * (i % 2)
            frames.append(frame)
        dark = not dark
    levels = np.array(frames, np.uint8)
    found = media.clips(media.Video(40_000, levels, b""))
    assert found[-1][1] == len(levels) * 40 and [a for a, *_ in found[1:]] == [b for _, b, _ in found[:-1]]
    return [a // 40 for a, *_ in found]


@pytest.mark.parametrize("gap", range(1, 13))
def test_two_cuts_close_together(gap):
    assert shots(9, gap, 9) == [0, 9, 9 + gap]


def test_cuts_at_the_first_frames():
    assert shots(1, 1) == [0, 1] and shots(1, 12) == [0, 1] and shots(1, 1, 12) == [0, 1, 2] and shots(2, 12) == [0, 2]
    assert shots(30) == [0] and shots(*[1] * 20) == [*range(20)]
    assert " clips=2 last_ms=40-80 peak=1.0000" in media.digest("\x10" * 2048 + "z" * 2048)[-1]


def test_media_columns(spark):
    texts = [None, "", "é" * 50, "x" * 64, "long " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = docs.select("doc_id", media.media("text").alias("file")).select("doc_id", "file", media.media_clips("file").alias("clips")).orderBy("doc_id").collect()
    assert [media.read_avi(bytes(r.file)).payload for r in rows] == [media.padded((t or "").encode()) for t in texts]
    assert all(r.clips[0].begin_ms == 0 for r in rows) and rows[0].file == rows[1].file
    n, size, digest, *_ = media.digest("é" * 50)
    assert (n, size, digest) == (100, 128, hashlib.sha256(("é" * 50).encode() + bytes(28)).hexdigest())
    assert docs.limit(0).select(media.media("text")).count() == 0


def test_counts_equal_the_tokenizer(own):
    rng = random.Random(6)
    texts = ["".join(rng.choice(" abcé\n▁ü<s>/😀  ") for _ in range(rng.randrange(3000))) for _ in range(60)]
    texts += ["x" * 5000, " " * 4000, "a b " * 2000, "é" * 3000, "▁ ▁" * 500, " lead and trail "]
    for chunk, overlap in ((64, 4), (200, 16), (1000, 50)):
        for text in texts:
            if text:
                assert token_counts.count_huge(own, text.encode(), chunk, overlap) == len(own.encode(text))


def test_token_counts_in_rows(spark, own, monkeypatch):
    import public_tokenizers

    texts = [None, "", "hello world", "<s> x </s>", "word " * 30000, "Ünïcödé " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = docs.select("doc_id", token_counts.token_count(spark, "text", public_tokenizers.path("piece_bpe_32k.model")).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in got] == [len(own.encode(t or "")) for t in texts]


def test_models_without_stable_boundaries_are_refused(monkeypatch):
    class Pieces:
        def __init__(self, **_): ...

        get_piece_size = staticmethod(lambda: 2)
        id_to_piece = staticmethod(["▁a", "a▁b"].__getitem__)

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Pieces)
    with pytest.raises(ValueError):
        token_counts.processor(b"other")
