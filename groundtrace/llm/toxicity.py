"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

The network is trained in numpy in the tasks, on every word of every labelled row. The rows are dealt to shards of about
``SHARD`` words; in a round each shard goes once through its rows by Adam, from the same network, and the networks that come out are
averaged, an embedding over the shards that changed it. For training and scoring, a text's words are read to the last, in blocks.

A word's vector is the sum of the embeddings of its hash and of the hashes of its beginnings, so that
inflected forms of a stem that the labelled rows hold speak alike. Words that have embeddings are counted over all these rows.

One threshold for each language, found on a part of the labelled rows that isn't trained on, is mapped to a
score of 0.5. The language is guessed from the words alone.

Defined results: a null or word-free text has the score of no evidence at all; equal texts have equal
scores; without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.llm.language import remainder
from groundtrace.llm.scratch import discard, materialise
from groundtrace.llm.words import U, batch_words, mix, slices

#: Words in a shard of the labelled rows, about; a shard has whole texts. Bounds a task's memory, not what is learned from.
SHARD = 1 << 21
#: Words, about, of the parts that shards are stored, sent and read in, and the settings for that: so that neither a row nor a batch is as
#: large as a shard, of which the JVM and a worker would hold several copies each.
PART = 1 << 15
SENT = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.parquet.columnarReaderBatchSize": "256"}
READ = SENT | {"spark.sql.parquet.columnarReaderBatchSize": "4"}
#: Shuffle files go as soon as the query that wrote them ends, and not when the driver happens to collect its garbage: else those of
#: the deal and of all rounds of training add up.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: How tables of words are written: their hashes repeat, in places that neither Parquet's dictionaries nor Snappy find.
STORED = {"compression": "zstd", "parquet.enable.dictionary": "false"}
#: A written table of parts has a row group for each file, so that the parts of a shard are read by one task, in order.
ONE_GROUP = STORED | {"parquet.block.size": str(1 << 30)}
#: An embedding is trained for words in at least this many labelled texts, however few these are: with fewer a small table is
#: learned by heart (two texts instead of six on the 330 labelled rows of sf0.01: 1 of 6 held-out toxic rows found instead of 4).
LEAST_TEXTS = 6
#: And in one of so many labelled texts at least, which bounds the model by this times the distinct words of a text, whatever the rows.
LEAST_SHARE = 10_000
#: Steps of the raw score between 0 and 1 in which thresholds are looked for; all rows are counted.
CELLS = 1 << 16
#: Labelled rows that are sent to every executor; more of them are joined to the documents by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Embeddings that are averaged by one task.
PIECE = 1 << 12
WIDTHS, FILTERS, DIMENSIONS, EPOCHS, BATCH = (1, 2, 3), 8, 8, 14, 32
#: Share of the words that a training step doesn't see.
DROPPED = 0.3
#: Words that are scored at a time. Bounds the temporary arrays, not the texts.
BLOCK = 1 << 14
ROWS_AT_ONCE = 512
PAD = max(WIDTHS) - 1
#: Beginnings of words, in bytes, that have embeddings of their own.
PREFIXES = (4, 6)
COLUMNS = 1 + len(PREFIXES)


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes of the words and beginnings with embeddings
    embedding: np.ndarray  # a row for each of them, the first for unknown ones
    filters: np.ndarray  # the matrices of all widths and places side by side
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    votes: np.ndarray  # a row for each word, a column for each language
    thresholds: np.ndarray  # for each language, at last for none


def hashed(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(32)).astype(np.uint32)


def spread(words: np.ndarray) -> np.ndarray:
    """Where the sorted words with each beginning of a hash begin, for about twice as many beginnings as words."""
    bits = min(len(words).bit_length() + 1, 24)
    return np.searchsorted(words, np.arange(1 << bits, dtype=np.uint32) << np.uint32(32 - bits)).astype(np.int32)


def numbered(words: np.ndarray, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """1 + the place of each hash among the words, 0 for unknown ones. ``begins``: ``spread`` of the words, which leaves a step or two to each."""
    if not len(words):
        return np.zeros(hashes.shape, np.int32)
    every = hashes.ravel()
    at = begins[every >> np.uint32(33 - len(begins).bit_length())]
    np.minimum(at, len(words) - 1, out=at)
    found = words[at]
    late = np.flatnonzero((found < every) & (at < len(words) - 1))
    while len(late):
        at[late] += 1
        now = words[at[late]]
        found[late] = now
        late = late[(now < every[late]) & (at[late] < len(words) - 1)]
    at += 1
    at *= found == every
    return at.reshape(hashes.shape)


def times(vectors: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Their product, by parts that are too small for more threads, which would only wait for each other."""
    whole = len(vectors) // ROWS_AT_ONCE * ROWS_AT_ONCE
    out = np.empty((len(vectors), filters.shape[1]), np.float32)
    np.matmul(vectors[:whole].reshape(-1, ROWS_AT_ONCE, len(filters)), filters, out=out[:whole].reshape(-1, ROWS_AT_ONCE, filters.shape[1]))
    np.matmul(vectors[whole:], filters, out=out[whole:])
    return out


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by unknown words, so that every window stays in its row."""
    rows = np.diff(first)
    start = first[:-1] + PAD * np.arange(len(rows))
    out = np.zeros((len(ids) + PAD * len(rows), ids.shape[1]), np.int32)
    out[np.arange(len(ids)) + np.repeat(PAD * np.arange(len(rows)), rows)] = ids
    return out, np.append(start, len(out))


def pooled(ids: np.ndarray, first: np.ndarray, embedding: np.ndarray, filters: np.ndarray, bias: dict[int, np.ndarray]) -> np.ndarray:
    """Max-pooled filter values of each row, widths side by side."""
    ids, first = padded(ids, first)
    more = np.concatenate([ids, np.zeros((PAD, ids.shape[1]), np.int32)])
    rows = len(first) - 1
    out = np.zeros((rows, len(WIDTHS) * FILTERS), np.float32)
    for low in range(0, len(ids), BLOCK):
        high = min(low + BLOCK, len(ids))
        a, b = np.searchsorted(first, low, "right") - 1, np.searchsorted(first, high, "left")
        cuts = np.maximum(first[a:b], low) - low
        vectors = embedding[more[low : high + PAD, 0]]
        for column in range(1, ids.shape[1]):
            vectors += embedding[more[low : high + PAD, column]]
        every = times(vectors, filters)
        part = 0
        for k, width in enumerate(WIDTHS):
            value = every[: high - low, part : part + FILTERS].copy()
            for j in range(1, width):
                value += every[j : high - low + j, part + j * FILTERS : part + (j + 1) * FILTERS]
            part += width * FILTERS
            best = np.maximum.reduceat(value, cuts, axis=0) + bias[width]
            pool = out[a:b, k * FILTERS : (k + 1) * FILTERS]
            np.maximum(pool, best, out=pool)
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def raw_scores(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _logistic(pooled(ids, first, model.embedding, model.filters, model.bias) @ model.out + model.out_bias)


def guessed(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The language that each row's words speak for; the last number for none."""
    if not model.votes.shape[1]:
        return np.zeros(len(first) - 1, np.int64)
    total = np.zeros((len(first) - 1, model.votes.shape[1]))
    some = np.flatnonzero(np.diff(first))
    for low in range(0, len(ids), BLOCK):
        high = min(low + BLOCK, len(ids))
        a, b = np.searchsorted(first[some], low, "right") - 1, np.searchsorted(first[some], high, "left")
        total[some[a:b]] += np.add.reduceat(model.votes[ids[low:high, 0]], np.maximum(first[some[a:b]], low) - low, axis=0)
    return np.where(total.max(axis=1) > total.min(axis=1), total.argmax(axis=1), total.shape[1])


def scores(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Between 0 and 1, with the threshold of the text's language at 0.5."""
    raw, least = raw_scores(model, ids, first).astype(float), model.thresholds[guessed(model, ids, first)]
    return np.clip(np.where(raw < least, 0.5 * raw / least, 0.5 + 0.5 * (raw - least) / (1 - least)), 0, 1)


def start(n: int) -> dict:
    """A network before training, with ``n`` embeddings."""
    rng = np.random.default_rng(11)
    state: dict = {"e": rng.normal(0, 0.1, (n, DIMENSIONS)), "o": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "c": np.zeros(1)}
    for w in WIDTHS:
        state["w", w] = rng.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS))
        state["b", w] = np.zeros(FILTERS)
    state["e"][0] = 0
    return state


def _vectors(embedding: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = embedding[ids[..., 0]]
    for column in range(1, ids.shape[-1]):
        out += embedding[ids[..., column]]
    return out


def strongest(state: dict, more: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest value of each filter in each row, without bias, and its place. ``more``: padded ids and ``PAD`` further ones."""
    rows, n = len(at) - 1, len(more) - PAD
    top, places = np.full((rows, len(WIDTHS) * FILTERS), -np.inf, np.float32), np.zeros((rows, len(WIDTHS) * FILTERS), np.int64)
    every = np.arange(len(WIDTHS) * FILTERS)
    filters = np.concatenate([state["w", w][j] for j in range(max(WIDTHS)) for w in WIDTHS if w > j], axis=1)
    for low in range(0, n, BLOCK):
        high = min(low + BLOCK, n)
        found = times(_vectors(state["e"], more[low : high + PAD]), filters)
        value, part = found[: high - low, : len(every)], len(every)
        for j in range(1, max(WIDTHS)):
            wide = FILTERS * sum(w > j for w in WIDTHS)
            value[:, len(every) - wide :] += found[j : high - low + j, part : part + wide]
            part += wide
        for r in range(np.searchsorted(at, low, "right") - 1, np.searchsorted(at, high, "left")):
            a = max(at[r], low)
            own = value[a - low : min(at[r + 1], high) - low]
            place = own.argmax(axis=0)
            best = own[place, every]
            places[r] = np.where(best > top[r], a + place, places[r])
            top[r] = np.maximum(top[r], best)
    return top, places


def _fit(state: dict, ids: list[np.ndarray], labels: np.ndarray, epochs: range) -> dict:
    """The network after these ways through the rows, by Adam on the log loss.

    Embeddings shrink only in a stretch that begins with the first way: with no moments yet, Adam would take the shrinking of one that no
    row has touched for its whole slope and wipe out what earlier rounds learned.
    """
    rng = np.random.default_rng(11 + epochs.start)
    state = {k: v.astype(np.float32) for k, v in state.items()}
    first = {k: np.zeros_like(v) for k, v in state.items()}
    second = {k: np.zeros_like(v) for k, v in state.items()}
    shrunk = np.float32(0 if epochs.start else 1e-5)
    steps = 0
    for _ in epochs:
        order = rng.permutation(len(ids))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            flat, at = padded(np.concatenate([ids[r] for r in rows]), np.cumsum([0, *(len(ids[r]) for r in rows)]))
            more = np.concatenate([flat, np.zeros((PAD, flat.shape[1]), np.int32)])
            more[rng.random(len(more), np.float32) < DROPPED] = 0
            values, places = strongest(state, more, at)
            values += np.concatenate([state["b", w] for w in WIDTHS])
            active = np.maximum(values, 0)
            wrong = (_logistic(active @ state["o"] + state["c"][0]) - labels[rows]) / len(rows)
            slope = {"o": active.T @ wrong + 1e-4 * state["o"], "c": np.array([wrong.sum()]), "e": shrunk * state["e"]}
            inner = np.outer(wrong, state["o"]) * (values > 0)
            for k, w in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                part = inner[:, own]
                slope["b", w] = part.sum(axis=0)
                slope["w", w] = 1e-4 * state["w", w]
                for j in range(w):
                    seen = more[places[:, own] + j]
                    slope["w", w][j] += np.einsum("nf,nfd->df", part, _vectors(state["e"], seen))
                    change = (part[:, :, None] * state["w", w][j].T[None]).astype(np.float32)
                    for column in range(flat.shape[1]):
                        np.add.at(slope["e"], seen[:, :, column], change)
            slope["e"][0] = 0
            steps += 1
            for k in state:
                own = slope[k].astype(np.float32, copy=False)
                first[k] *= np.float32(0.9)
                first[k] += np.float32(0.1) * own
                own *= own
                second[k] *= np.float32(0.99)
                second[k] += np.float32(0.01) * own
                size = np.sqrt(second[k] * np.float32(1 / (1 - 0.99**steps)))
                size += np.float32(1e-8)
                state[k] -= np.float32(0.01 / (1 - 0.9**steps)) * first[k] / size
    return state


def threshold(values: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The cut from 0.5 up with the highest F1; of several the middle of the widest gap. ``values``: ascending scores, with the rows of each."""
    cuts = np.unique(np.concatenate([[0.5, 0.98], values]))
    mids = np.clip((cuts[1:] + cuts[:-1]) / 2, 0.5, 0.98)
    at = np.searchsorted(values, mids, "left")
    right, above = (np.append(n[::-1].cumsum()[::-1], 0)[at] for n in (toxic, toxic + clean))
    f1 = 2 * right / (above + toxic.sum())
    return float(max(zip(f1, np.diff(cuts), mids, strict=True))[2])


class Shard(NamedTuple):
    """Labelled rows that a task learns from at a time."""

    number: int
    ids: np.ndarray  # hashes of the words and their beginnings, or rows of their embeddings
    first: np.ndarray
    labels: np.ndarray
    held: np.ndarray  # rows that only the thresholds are found on
    languages: list[str | None]

    def rows(self, which: np.ndarray) -> list[np.ndarray]:
        return [self.ids[self.first[r] : self.first[r + 1]] for r in which]

    def packed(self, last: bool) -> pa.RecordBatch:
        """One row of ``PACKED``, a part of a shard or its ``last`` one."""
        columns = (self.ids, self.first, self.labels.astype(np.int8), self.held.astype(np.int8))
        row = [pa.array([self.number]), pa.array([last]), *(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([self.languages], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(row, [c.split(" ")[0] for c in PACKED.split(", ")])


PACKED = "shard bigint, last boolean, ids binary, first binary, labels binary, held binary, languages array<string>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PACKED`` of rows (shard, label, lang, words, tie) that are sorted by shard. A part has whole texts."""
    held: list[pa.RecordBatch] = []

    def part(last: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        words = rows["words"].combine_chunks()
        ids = words.flatten().to_numpy().reshape(-1, COLUMNS)
        first = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))) // COLUMNS
        apart = rows["tie"].to_numpy().astype(np.uint64) % U(4) == 0
        return Shard(rows["shard"][0].as_py(), ids, first, rows["label"].to_numpy() > 0, apart, rows["lang"].to_pylist()).packed(last)

    size = 0
    for batch in batches:
        words = pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False) // COLUMNS
        low = 0
        for at, (shard, more) in enumerate(zip(batch["shard"].to_pylist(), words.tolist(), strict=True)):
            before = batch["shard"][at - 1].as_py() if at else held[-1]["shard"][-1].as_py() if held else shard
            if shard != before or size + more > PART and size:
                held += [batch.slice(low, at - low)] if at > low else []
                low, size = at, 0
                yield part(shard != before)
            size += more
        held += [batch.slice(low)] if batch.num_rows > low else []
    if held:
        yield part(True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, bool]]:
    """Each part, and whether it is the last of its shard."""
    for batch in batches:
        for number, last, ids, first, labels, held, languages in zip(*batch.columns, strict=True):
            ids, first, labels, held = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((ids, np.int32), (first, np.int64), (labels, np.int8), (held, np.int8)))
            yield Shard(number.as_py(), ids.reshape(-1, COLUMNS), first, labels.astype(int), held > 0, languages.as_py()), last.as_py()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The shards, whole."""
    parts: list[Shard] = []
    for part, last in _parts(batches):
        parts.append(part._replace(ids=part.ids.copy()))  # else its batch stays, too
        if {p.number for p in parts} != {part.number}:
            raise ValueError("the parts of a shard are not together")
        if last:
            first = np.cumsum([0, *(n for p in parts for n in np.diff(p.first))])
            whole = Shard(part.number, np.concatenate([p.ids for p in parts]), first, *(np.concatenate([p[k] for p in parts]) for k in (3, 4)), [x for p in parts for x in p.languages])
            parts.clear()
            yield whole
    if parts:
        raise ValueError("a shard has no last part")


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """With these settings in the session, which has its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _counted(shard: Shard) -> pa.RecordBatch:
    """(hash, texts): in how many texts that are trained on a hash is."""
    seen, texts = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.unique(row) for row in shard.rows(np.flatnonzero(~shard.held)))]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(texts)], ["hash", "texts"])


def _spoken(shard: Shard) -> pa.RecordBatch:
    """(place, lang, texts): in how many texts of a language that are trained on a known word is."""
    out = [(np.zeros(0, np.int64), [], np.zeros(0, np.int64))]
    for name in sorted({x for x in shard.languages if x is not None}):
        which = np.flatnonzero(~shard.held & np.array([x == name for x in shard.languages]))
        at, texts = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.unique(row[:, 0]) for row in shard.rows(which))]), return_counts=True)
        out.append((at.astype(np.int64), [name] * len(at), texts))
    at, lang, texts = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array([x for names in lang for x in names], pa.string()), pa.array(np.concatenate(texts))], ["place", "lang", "texts"])


def _flat(state: dict) -> np.ndarray:
    """All but the embeddings of a network, one after another."""
    return np.concatenate([v.ravel() for k, v in state.items() if k != "e"]).astype(np.float32)


def _filled(state: dict, values: np.ndarray) -> dict:
    """A network of the shapes of another one, with its embeddings."""
    out, low = {"e": state["e"]}, 0
    for k, v in state.items():
        if k != "e":
            out[k] = values[low : low + v.size].reshape(v.shape)
            low += v.size
    return out


TAUGHT = "piece bigint, shard bigint, at binary, value binary"


def _taught(shard: Shard, state: dict, epochs: range) -> pa.RecordBatch:
    """The network that a shard makes of one: the embeddings that it changes in pieces, and the rest, which is piece -1."""
    used = np.flatnonzero(~shard.held)
    out = []
    if len(used):
        ids = shard.rows(used)
        held = np.zeros(len(state["e"]), bool)
        for row in ids:
            held[row] = True
        held[0] = True
        known = np.flatnonzero(held)
        number = (np.cumsum(held) - 1).astype(np.int32)
        after = _fit({**state, "e": state["e"][known]}, [number[row] for row in ids], shard.labels[used], epochs)
        changed = (after["e"] != state["e"][known]).any(axis=1)
        known, embeddings = known[changed].astype(np.int32), after["e"][changed]
        begins = np.searchsorted(known, np.arange(0, len(held) + PIECE, PIECE))
        out = [(k, known[a:b], embeddings[a:b]) for k, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)) if a < b]
        out.append((-1, np.zeros(0, np.int32), _flat(after)))
    columns = [pa.array([o[0] for o in out], pa.int64()), pa.array([shard.number] * len(out), pa.int64()), *(pa.array([o[k].tobytes() for o in out], pa.binary()) for k in (1, 2))]
    return pa.RecordBatch.from_arrays(columns, ["piece", "shard", "at", "value"])


def _averaged(table: pa.Table) -> pa.Table:
    """A piece of the networks of all shards, each value averaged over the shards that have it, in the shards' order."""
    table = table.sort_by("shard")
    piece = table["piece"][0].as_py()
    values = [np.frombuffer(v.as_buffer(), np.float32) for v in table["value"]]
    if piece < 0:
        at, mean = np.zeros(0, np.int32), np.mean(values, axis=0, dtype=float)
    else:
        total, shards = np.zeros((PIECE, DIMENSIONS)), np.zeros(PIECE, np.int64)
        for own, value in zip(table["at"], values, strict=True):
            own = np.frombuffer(own.as_buffer(), np.int32) - piece * PIECE
            total[own] += value.reshape(-1, DIMENSIONS)
            shards[own] += 1
        at = np.flatnonzero(shards)
        mean = total[at] / shards[at, None]
        at = (at + piece * PIECE).astype(np.int32)
    return pa.table([pa.array([piece]), pa.array([-1]), pa.array([at.tobytes()], pa.binary()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["piece", "shard", "at", "value"])


def _trained(shards: DataFrame, number: int, n: int) -> dict:
    """The network after ``EPOCHS`` ways through all rows: of one shard at a stretch, of several averaged after each."""
    context, state = shards.sparkSession.sparkContext, start(n)
    for epochs in [range(EPOCHS)] if number == 1 else [range(k, k + 1) for k in range(EPOCHS)]:
        state = {k: v.astype(np.float32) for k, v in state.items()}
        shared = context.broadcast(state)

        def teach(batches: Iterator[pa.RecordBatch], shared=shared, epochs=epochs) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches):
                yield _taught(shard, shared.value, epochs)

        table = shards.mapInArrow(teach, TAUGHT).groupBy("piece").applyInArrow(_averaged, TAUGHT).toArrow()
        for piece, at, value in zip(table["piece"].to_pylist(), table["at"], table["value"], strict=True):
            own = np.frombuffer(value.as_buffer(), np.float32)
            if piece < 0:
                state = _filled(state, own)
            else:
                state["e"][np.frombuffer(at.as_buffer(), np.int32)] = own.reshape(-1, DIMENSIONS)
        shared.destroy()
    return state


def _judged(shard: Shard, model: Model, held: bool) -> pa.RecordBatch:
    """(spoken, label, cell, n): the rows of each guessed language, label and step of the raw score, of those held back or of the others."""
    which = np.flatnonzero(shard.held == held)
    cells = []
    for r, ids in zip(which, shard.rows(which), strict=True):  # a text at a time
        first = np.array([0, len(ids)])
        raw = float(raw_scores(model, ids, first)[0])
        cells.append((int(guessed(model, ids, first)[0]), int(shard.labels[r]), min(int(raw * CELLS), CELLS - 1)))
    every, n = np.unique(np.array(cells, np.int64).reshape(-1, 3), axis=0, return_counts=True)
    return pa.RecordBatch.from_arrays([*(pa.array(every[:, k]) for k in range(3)), pa.array(n)], ["spoken", "label", "cell", "n"])


def train(hashes: DataFrame, number: int, texts: int) -> Model:
    """``hashes``: the parts of ``number`` shards, a written table, with so many ``texts`` to train on. It is deleted when its words are numbered.

    What comes to the driver is bounded by the model and by ``CELLS``, for each language.
    """
    with _set(hashes.sparkSession, READ | FREED):
        return _train(hashes, number, texts)


def _train(hashes: DataFrame, number: int, texts: int) -> Model:
    spark = hashes.sparkSession

    def mapped(rows: DataFrame, of, schema: str) -> DataFrame:
        return rows.mapInArrow(lambda batches: (of(shard) for shard in _shards(batches)), schema)

    least = max(LEAST_TEXTS, texts / LEAST_SHARE)
    known = mapped(hashes, _counted, "hash int, texts bigint").groupBy("hash").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= least).select("hash").toArrow()
    nothing = hashed(mix(np.zeros(1, U)))  # the beginning of a word that is no longer than it
    known = np.setdiff1d(known["hash"].to_numpy().view(np.uint32), nothing)
    words = spark.sparkContext.broadcast(known)

    def number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = spread(words.value)
        return (part._replace(ids=numbered(words.value, part.ids.view(np.uint32), begins)).packed(last) for part, last in _parts(batches))

    shards = materialise(hashes.mapInArrow(number_words, PACKED), "numbered", **ONE_GROUP)
    discard(hashes)
    state = _trained(shards, number, len(known) + 1)
    spoken = mapped(shards, _spoken, "place bigint, lang string, texts bigint").groupBy("place", "lang").agg(F.sum("texts").alias("texts")).toArrow()
    names = sorted(spoken["lang"].unique().to_pylist())
    votes = np.zeros((len(known) + 1, len(names)))
    votes[spoken["place"].to_numpy(), pc.index_in(spoken["lang"], pa.array(names, pa.string())).to_numpy()] = spoken["texts"].to_numpy()
    votes = np.log((votes + 0.1) / (votes.sum(axis=1, keepdims=True) + 0.1 * max(len(names), 1)))
    votes[0] = 0
    beside = np.concatenate([state["w", w][j] for w in WIDTHS for j in range(w)], axis=1).astype(np.float32)
    bias = {w: state["b", w].astype(np.float32) for w in WIDTHS}
    model = Model(known, state["e"].astype(np.float32), beside, bias, state["o"].astype(np.float32), float(state["c"][0]), votes, np.full(len(names) + 1, 0.5))
    shared = spark.sparkContext.broadcast(model)

    def judged(held: bool) -> tuple[np.ndarray, ...]:
        rows = mapped(shards, lambda shard: _judged(shard, shared.value, held), "spoken bigint, label bigint, cell bigint, n bigint")
        table = rows.groupBy("spoken", "label", "cell").agg(F.sum("n").alias("n")).toArrow()
        return tuple(table[c].to_numpy() for c in ("spoken", "label", "cell", "n"))

    spoken, label, cell, rows = judged(True)
    if len(np.unique(label)) < 2:
        spoken, label, cell, rows = judged(False)

    def best(own: np.ndarray) -> float:
        values, at = np.unique(cell[own], return_inverse=True)
        toxic, clean = (np.bincount(at, rows[own] * (label[own] == k), len(values)) for k in (1, 0))
        return threshold((values + 0.5) / CELLS, toxic, clean)

    every = best(np.full(len(cell), True))
    for k in range(len(names) + 1):
        own = spoken == k
        enough = min(rows[own & (label == 1)].sum(), rows[own & (label == 0)].sum()) >= 20
        model.thresholds[k] = best(own) if enough else every
    shared.destroy()
    words.destroy()
    discard(shards)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all words of all labelled rows whose crc32 remainder isn't 0."""
    with _set(docs.sparkSession, SENT | FREED):
        return _learn(docs, labels)


def _learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(remainder("doc_id", 5) != 0)
    marked = materialise(marked.groupBy("doc_id").agg(F.max("toxic").alias("label")), "marked")
    chosen = F.broadcast(marked) if marked.count() <= BROADCAST_LABELS else marked

    def hash_words(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([hash_part(part) for part in slices(texts)])

    def hash_part(texts: pa.Array) -> pa.Array:
        words = batch_words(texts, PREFIXES)
        return pa.ListArray.from_arrays(pa.array((words.first * COLUMNS).astype(np.int32)), pa.array(hashed(words.hash).ravel().view(np.int32)))

    own = docs.select("doc_id", "text", "lang").join(chosen, "doc_id")
    rows = own.select("doc_id", "label", "lang", F.arrow_udf(hash_words, "array<int>")("text").alias("words"), F.xxhash64("text").alias("tie"))
    rows = materialise(rows, "labelled", **STORED)
    discard(marked)
    trained = F.pmod("tie", F.lit(4)) != 0
    words, *kinds = rows.agg(F.sum(F.size("words").cast("long")), F.count_if(trained & (F.col("label") <= 0)), F.count_if(trained & (F.col("label") > 0))).first()
    if not min(kinds):
        discard(rows)
        return None
    number = -(-words // (SHARD * COLUMNS)) or 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(number))).repartition(number, "shard").sortWithinPartitions("shard", "doc_id", "tie", "lang")
    shards = materialise(dealt.select("shard", "label", "lang", "words", "tie").mapInArrow(_packed, PACKED), "shards", **ONE_GROUP)
    discard(rows)
    return train(shards, number, sum(kinds))


def toxicity(spark: SparkSession, model: Model | None, text: Column | str) -> Column:
    """Score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        begins = None if own is None else spread(own.words)
        for texts in batches:
            if own is None:
                yield pa.array(np.zeros(len(texts)))
                continue
            parts = (batch_words(part, PREFIXES) for part in slices(texts))
            yield pa.array(np.concatenate([scores(own, numbered(own.words, hashed(words.hash), begins), words.first) for words in parts]))

    return F.arrow_udf(score, "double")(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """struct ``row`` of all columns, and ``score``."""
    model = learn(docs, labels)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), toxicity(docs.sparkSession, model, "text").alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a score under 0.5."""
    return scored(docs, labels).filter("score < 0.5").select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        (remainder("row.doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
