"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of consecutive words of every item. A document's words are streamed
through it; the state keeps the longest suffix of the words read so far that is a run of an item. A
position where that length reaches ``window`` ends an occurrence of an item's window, and the words of
all occurrences together are the document's contaminated words.

Only stretches of words whose neighbouring pairs all occur in an item can hold an occurrence, so only
these are streamed; the others, nearly all words, are dismissed by a vectorised look-up of the pairs.

Defined results: a null or word-free document has no words, no hits and stays as it is; a null item text
has no windows; the windows of an item without an id count as hits, but the item is in no list; an item of fewer words than ``window``, but not none, is one window as a whole; equal
items each count; repeated documents are judged row by row; columns other than the text pass through.
"""

from __future__ import annotations

import pickle
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.llm.scratch import materialise
from groundtrace.llm.words import Words, batch_words, slices

#: Words of an item that count as an occurrence.
WINDOW = 10
#: Item words in one automaton, about: 150 MB while one is built in a task. A larger benchmark is cut into blocks of items.
BLOCK_WORDS = 200_000
#: Bytes of automata that are sent to the executors at a time; the blocks of a larger benchmark are applied in several passes.
SHARED_BYTES = 1 << 27
#: A document of which more than this share of words is contaminated goes altogether.
COVERAGE = 0.9


class Tables(NamedTuple):
    """A finished automaton as arrays: about 100 bytes for each word of its items, read as they lie."""

    window: int
    least: int  # words of the shortest window
    vocabulary: np.ndarray  # sorted hashes of the words; a word's number is its place
    pairs: np.ndarray  # sorted numbers of neighbouring words
    size: np.ndarray  # of each state the words of its longest run
    link: np.ndarray  # of each state that of the longest suffix in another one
    above: np.ndarray  # of each state the nearest proper suffix that is a whole short item, or -1
    steps: np.ndarray  # sorted: state * words + word
    leads: np.ndarray  # where each of them leads
    short: dict[int, list[tuple[int, str | None]]]  # short items by their states
    held: dict[int, set[str | None]]  # items by the states of their windows


def build(items: list[tuple[str | None, np.ndarray]], window: int) -> Tables:
    """The generalised suffix automaton of the items' word hashes, with the items that hold each window."""
    every = np.concatenate([words for _, words in items]) if items else np.zeros(0, np.uint64)
    vocabulary = np.unique(every)
    size, link, step = [0], [-1], [{}]

    def clone(p: int, word: int, q: int) -> int:
        twin = len(size)
        size.append(size[p] + 1)
        link.append(link[q])
        step.append(dict(step[q]))
        link[q] = twin
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = twin
            p = link[p]
        return twin

    def extend(last: int, word: int) -> int:
        if word in step[last]:
            q = step[last][word]
            return q if size[q] == size[last] + 1 else clone(last, word, q)
        new, p = len(size), last
        size.append(size[last] + 1)
        link.append(0)
        step.append({})
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            link[new] = q if size[q] == size[p] + 1 else clone(p, word, q)
        return new

    coded = [(item, np.searchsorted(vocabulary, words)) for item, words in items if len(words)]
    for _, code in coded:
        state = 0
        for word in code.tolist():
            state = extend(state, word)
    keys = np.array([at * len(vocabulary) + word for at, own in enumerate(step) for word in own], np.int64)
    leads = np.array([to for own in step for to in own.values()], np.int32)
    order = np.argsort(keys)
    pairs = [c[:-1] * len(vocabulary) + c[1:] for _, c in coded if len(c) > 1]
    least = min((min(len(c), window) for _, c in coded), default=window)
    sizes, links = np.array(size, np.int32), np.array(link, np.int32)
    out = Tables(window, least, vocabulary, np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64), sizes, links, np.full(len(size), -1, np.int32), keys[order], leads[order], {}, {})
    del step, size, link
    reader = Automaton(out)
    for item, code in coded:  # the states are final only now
        if len(code) < window:
            state = 0
            for word in code.tolist():
                state = reader.next(state, word)
            out.short.setdefault(reader.holder(state, len(code)), []).append((len(code), item))
    for state in np.argsort(sizes, kind="stable").tolist()[1:]:
        up = int(links[state])
        out.above[state] = up if up in out.short else out.above[up]
    for item, code in coded:
        if len(code) >= window:
            for state, length, _ in reader.stream(code.tolist()):
                if length >= window:
                    out.held.setdefault(reader.holder(state, window), set()).add(item)
    return out


class Automaton:
    """Reads words through the tables of a suffix automaton."""

    def __init__(self, tables: Tables) -> None:
        self.tables, self.steps, self.words = tables, memoryview(tables.steps), len(tables.vocabulary)

    def next(self, state: int, word: int) -> int:
        """The state after one more word, -1 if there is none."""
        key = state * self.words + word
        at = bisect_left(self.steps, key)
        return int(self.tables.leads[at]) if at < len(self.steps) and self.steps[at] == key else -1

    def holder(self, state: int, length: int) -> int:
        """The state for the suffix of that many words."""
        size, link = self.tables.size, self.tables.link
        while state and size[link[state]] >= length:
            state = int(link[state])
        return state

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(state, longest matching length, position) after each word."""
        size, link = self.tables.size, self.tables.link
        state = length = 0
        for at, word in enumerate(words):
            to = self.next(state, word)
            while to < 0 and state:
                state = int(link[state])
                length = int(size[state])
                to = self.next(state, word)
            if to >= 0:
                state, length = to, length + 1
            yield state, length, at

    def occurrences(self, words: list[int]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first position, position after the last, items) of each window that occurs."""
        window, short, held, above = self.tables.window, self.tables.short, self.tables.held, self.tables.above
        for state, length, at in self.stream(words):
            if length >= window:
                yield at + 1 - window, at + 1, held[self.holder(state, window)]
            up = state if state in short else int(above[state])
            while up >= 0:
                for size, item in short.get(up, ()):
                    if up != state or size <= length:
                        yield at + 1 - size, at + 1, {item}
                up = int(above[up])

    def find(self, words: Words) -> dict[int, tuple[np.ndarray, set[str | None]]]:
        """row -> (flag for each of its words, items) for the rows that hold a window."""
        vocabulary, n, pairs, least = self.tables.vocabulary, self.words, self.tables.pairs, self.tables.least
        if not n or not len(words.hash):
            return {}
        code = np.searchsorted(vocabulary, words.hash)
        code[code == n] = 0
        known = vocabulary[code] == words.hash
        joined = np.zeros(len(code), bool)  # the pair of this word and the next is in an item, in one row
        maybe = np.flatnonzero(known[:-1] & known[1:])
        if len(pairs) and len(maybe):
            pair = code[maybe] * n + code[maybe + 1]
            at = np.searchsorted(pairs, pair)
            at[at == len(pairs)] = 0
            joined[maybe[pairs[at] == pair]] = True
        inner = words.first[1:-1]
        joined[inner[inner > 0] - 1] = False
        edge = np.diff(np.concatenate([[False], known, [False]]).astype(np.int8))
        if least > 1:
            edge = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + (least > 1)
        long = end - begin >= least
        found: dict[int, tuple[np.ndarray, set[str | None]]] = {}
        for low, high in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            row = int(np.searchsorted(words.first, low, "right")) - 1
            while low < high:  # a stretch of single words may go over rows
                stop = min(high, int(words.first[row + 1]))
                for a, b, items in self.occurrences(code[low:stop].tolist()):
                    if row not in found:
                        found[row] = np.zeros(words.first[row + 1] - words.first[row], bool), set()
                    found[row][0][low - words.first[row] + a : low - words.first[row] + b] = True
                    found[row][1].update(items)
                low, row = stop, row + 1
        return found


def automata(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, size, tables): a written table of the automata of all items, built in tasks of about ``block_words`` words each.

    Which block holds an item is decided by a hash; only one block's items are in a task.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter("text IS NOT NULL")
    most = items.agg(F.sum(F.length("text"))).first()[0] or 0  # twice the words, or more
    blocks = max(1, -(-most // (2 * block_words)))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))

    def one_block(rows: pa.Table) -> pa.Table:
        own = [(name.as_py(), batch_words(pa.array([body.as_py()], pa.string())).hash) for name, body in zip(rows["item"], rows["text"], strict=True)]
        data = pickle.dumps(tuple(build([(name, words) for name, words in own if len(words)], window)), protocol=5)
        return pa.table({"block": rows["block"][:1], "size": pa.array([len(data)], pa.int64()), "tables": pa.array([data], pa.large_binary()).cast(pa.binary())})

    return materialise(items.groupBy("block").applyInArrow(one_block, "block bigint, size bigint, tables binary"), "automata")


def _groups(blocks: DataFrame) -> list[list[int]]:
    """The blocks in groups of at most ``SHARED_BYTES`` (or one block), each of which is sent to the executors at once."""
    out: list[list[int]] = []
    room = 0
    for block, size in sorted((r.block, r.size) for r in blocks.select("block", "size").collect()):
        if size > room:
            out.append([])
            room = SHARED_BYTES
        out[-1].append(block)
        room -= size
    return out or [[]]


def _shared(blocks: DataFrame, group: list[int]) -> Broadcast:
    rows = blocks.filter(F.col("block").isin(*group)).select("tables").collect() if group else []
    return blocks.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [bytes(r.tables) for r in rows]))


_OPEN: dict[str, list[Automaton]] = {}


def _found(shared: Broadcast, words: Words) -> dict[int, tuple[np.ndarray, set[str | None]]]:
    """What the group's automata find; a worker opens a group once and holds one at a time."""
    name, tables = shared.value
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = [Automaton(Tables(*pickle.loads(data))) for data in tables]
    found: dict[int, tuple[np.ndarray, set[str | None]]] = {}
    for automaton in _OPEN[name]:
        for row, (flags, items) in automaton.find(words).items():
            found[row] = (found[row][0] | flags, found[row][1] | items) if row in found else (flags, items)
    return found


REPORT = "struct<n_words: bigint, spans: array<struct<low: bigint, high: bigint>>, items: array<string>>"


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _report(shared: Broadcast, text: str) -> Column:
    """Words, contaminated stretches of words and items of a text by one group of blocks."""

    def report(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([report_part(part) for part in slices(texts)])

    def report_part(texts: pa.Array) -> pa.Array:
        words = batch_words(texts)
        n = np.diff(words.first).astype(np.int64)
        spans: list[list[dict[str, int]]] = [[] for _ in range(len(n))]
        items: list[list[str]] = [[] for _ in range(len(n))]
        for row, (flags, held) in _found(shared, words).items():
            spans[row], items[row] = [{"low": a, "high": b} for a, b in _spans(flags)], sorted(x for x in held if x is not None)
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return F.arrow_udf(report, REPORT)(text)


def contamination(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of each row of ``docs`` (doc_id, text): contaminated words, and the ids of the items in order.

    Groups of blocks are applied one after another, with what was found so far written in between.
    """
    groups = _groups(blocks)
    rows = docs.select("doc_id", "text")
    for k, group in enumerate(groups):
        rows = rows.withColumn(f"found{k}", _report(_shared(blocks, group), "text"))
        if k + 1 < len(groups):
            rows = materialise(rows, "found")
    found = [F.col(f"found{k}") for k in range(len(groups))]
    if len(found) == 1:
        spans, items = found[0]["spans"], found[0]["items"]
    else:  # words that several groups hit count once
        spans = F.array_sort(F.concat(*[f["spans"] for f in found]))
        items = F.array_sort(F.array_distinct(F.concat(*[f["items"] for f in found])))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["high"] - F.greatest(s["low"], a["to"]))).alias("n"), F.greatest(a["to"], s["high"]).alias("to"))
    return rows.select("doc_id", found[0]["n_words"].alias("n_words"), F.aggregate(spans, zero, add, lambda a: a["n"]).alias("n_hit"), items.alias("items"))


def _cleaned(shared: Broadcast, text: str, coverage: float) -> Column:
    """struct(changed, text): the text without its contaminated spans where there are any, null where they are over ``coverage`` of its words.

    A removed span leaves a line break. The result is searched again until it holds no window, as
    what stood around a span may form a new one. Texts without a window stay byte for byte.
    """

    def cut(raw: bytes, words: Words, row: int, flags: np.ndarray) -> bytes:
        first, base = int(words.first[row]), int(words.rows[row])
        out, last = [], 0
        for a, b in _spans(flags):
            out.append(raw[last : int(words.start[first + a]) - base])
            last = int(words.end[first + b - 1]) - base
        return b"\n".join([*out, raw[last:]])

    def clean(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([clean_part(part) for part in slices(texts)])

    def clean_part(texts: pa.Array) -> pa.Array:
        words = batch_words(texts)
        found = _found(shared, words)
        out: list[str | None] = [None] * len(texts)  # texts that stay aren't sent back
        for row, (flags, _) in found.items():
            if flags.sum() > coverage * len(flags):
                continue
            text, part, at = texts[row].as_py(), words, row
            while flags is not None:
                text = cut(text.encode(), part, at, flags).decode()
                part, at = batch_words(pa.array([text], pa.string())), 0
                flags = _found(shared, part).get(0, (None, None))[0]
            out[row] = text
        return pa.StructArray.from_arrays([pa.array([row in found for row in range(len(texts))], pa.bool_()), pa.array(out, pa.string())], ["changed", "text"])

    return F.arrow_udf(clean, "struct<changed: boolean, text: string>").asNondeterministic()(text)  # so that a filter on it doesn't compute it again


def _without(docs: DataFrame, shared: Broadcast, coverage: float) -> DataFrame:
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _cleaned(shared, "text", coverage).alias("new"))
    both = both.filter("NOT new.changed OR new.text IS NOT NULL")
    kept = F.when(F.col("new.changed"), F.col("new.text")).otherwise(F.col("row.text"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": kept}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("new.changed"), F.length("new.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return both.select([v.alias(c) for c, v in out.items()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the spans that occur in ``benchmark``; documents over the coverage limit go.

    ``n_chars`` follows the text where the text changed. Groups of blocks are applied one after another, and all of them
    again until nothing changes, as what one group leaves may form a window of another.
    """
    blocks = automata(benchmark, window=window, block_words=block_words)
    groups = _groups(blocks)
    if len(groups) == 1:
        return _without(docs, _shared(blocks, groups[0]), coverage)
    text = F.sum(F.xxhash64("text").cast("decimal(38,0)"))
    before, now = None, docs.agg(F.count("*"), text).first()
    while now != before:
        for group in groups:
            docs = materialise(_without(docs, _shared(blocks, group), coverage), "cleaned")
        before, now = now, docs.agg(F.count("*"), text).first()
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, automata(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_SQL_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS ir, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, p, p + least(len(w), {WINDOW}) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM i WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)
),
m AS (SELECT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, k)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
its AS (SELECT r, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
