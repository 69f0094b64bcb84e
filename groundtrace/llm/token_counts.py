"""Token counts of whole texts, huge ones in overlapping chunks that are resynchronised.

A sentencepiece BPE piece of the models accepted here has its blank marker only at its start, so no
merge ever crosses from a non-blank to a following blank: such a place is a *stable* boundary, and the
pieces on its two sides don't depend on each other. A huge text is encoded in chunks that overlap; the
pieces' offsets of two neighbours are spliced at the last common boundary that is stable. Where the
overlap holds none, it is widened, at last to the whole of what came before.

Defined results: null counts as empty, an empty text has no tokens; equal texts have equal counts.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of more UTF-8 bytes than this are encoded in chunks of this size.
CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Bytes of texts that are encoded in one call; bounds the lists of ids that exist at a time.
TOGETHER = 1 << 20
LIMIT = 4096
BLANK = "▁"


@cache
def processor(model: bytes):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (own.id_to_piece(i) for i in range(own.get_piece_size()))
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("a piece of this model goes over a blank: chunks of its texts have no stable boundaries")
    return own


def _char_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _stable(raw: bytes, at: int) -> bool:
    return 0 < at < len(raw) and raw[at] == 0x20 and raw[at - 1] != 0x20 and raw[max(at - 3, 0) : at] != BLANK.encode()


def _boundaries(own, raw: bytes, low: int, high: int) -> list[int]:
    """Where the pieces of ``raw[low:high]`` begin, in order."""
    return [low + p.begin for p in own.encode(raw[low:high].decode(), out_type="proto").pieces]


def count_huge(own, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, by chunks."""
    total, low, high = 0, 0, _char_start(raw, min(chunk, len(raw)))
    left = _boundaries(own, raw, low, high)
    since = 0  # pieces of the left chunk that begin before this offset are counted already
    while high < len(raw):
        width = overlap
        while True:
            start = _char_start(raw, max(high - width, since))
            stop = _char_start(raw, min(start + chunk + width, len(raw)))
            right = _boundaries(own, raw, start, stop)
            common = [p for p in sorted({*left}.intersection(right)) if start < p < high and p > since and _stable(raw, p)]
            if common:
                at = common[-1]
                total += sum(since <= p < at for p in left)
                left, since, high = right, at, stop
                break
            if start <= since:  # all that is left of the left chunk overlaps: go on with it, longer
                start = low
                high = _char_start(raw, min(low + 2 * (stop - low), len(raw)))
                left = _boundaries(own, raw, low, high)
                break
            width *= 2
        low = start
    return total + sum(p >= since for p in left)


def count_tokens(texts: pa.Array, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    own, counts, batch, size = processor(model), [0] * len(texts), [], 0

    def flush() -> None:
        for at, ids in zip([at for at, _ in batch], own.encode([t for _, t in batch], num_threads=1), strict=True):
            counts[at] = len(ids)

    for at, scalar in enumerate(texts):
        text = scalar.as_py() or ""
        raw = text.encode()
        if len(raw) > chunk:
            counts[at] = count_huge(own, raw, chunk, overlap)
        elif raw:
            batch.append((at, text))
            size += len(raw)
            if size >= TOGETHER:
                flush()
                batch, size = [], 0
    if batch:
        flush()
    return counts


def token_count(spark: SparkSession, text: Column | str, model_path: str) -> Column:
    """Column of token counts. The model file (its size is fixed by its vocabulary) is read on the driver and sent along."""
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())

    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts, model.value), pa.int64())

    return F.arrow_udf(counted, "bigint")(text)


def op10_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(spark, "text", model_path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
