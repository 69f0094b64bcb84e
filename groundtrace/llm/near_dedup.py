"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A document is its sequence of shingles (five words; all of its words where there are fewer), each labelled
with its number of occurrence. For each of ``FUNCTIONS`` hash functions the ``KEPT`` labelled shingles of
the least hashes, in the order of the text, make one entry of the sketch: two documents agree in an entry
if they share these shingles and their order, which falls with edits and with moved blocks. ``ROWS``
entries make a band. Two documents are candidates if they share a band and agree in ``LEAST_AGREED`` of all entries,
and if they have enough words in common by the counts of their words in ``BINS`` bins, which no similar pair fails (``most_common``);
that is asked of every pair alike, however many others share the band.

Two candidates are similar if an alignment of their words in order matches m of them with m / (a + b - m) at
least ``SIMILARITY``. That leaves at most (a + b) / 9 words unmatched, so the alignment is confined to a band
of that many diagonals. A text of which one word in twenty was changed is similar to what it was before (0.90), though
a quarter or more of its shingles are others.

Copies of one word sequence are folded into one representative first. In a bucket of a band every
representative is compared with the bucket's pivot, the member that meets most others: first with the pivot that it meets most often,
then, if that didn't put them in one component, with its others. Then all members of a bucket that are still in
different components are compared by their sketches, in blocks of ``BLOCK_MEMBERS`` against as many, and only candidates
leave a block: no pairs are made inside a class, and no bucket is in one task. A pair is looked at in the first band that it shares.
Classes are the connected components of all links, found by alternating star contraction.

Defined results: a null text and a text without words are a class of their own; rows with a null doc_id
are left out of the classes' table; the class id is the least doc_id; rows repeated with doc_id are one
document (of different texts under one doc_id, all are compared and all belong to its class).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.llm.scratch import attached, discard, materialise
from groundtrace.llm.words import U, batch_words, constants, cuts, mix, per_row, powers, slices

SHINGLE = 5
SIMILARITY = 0.8
KEPT = 2
#: Entries in a band, and bands. Two texts with a share J of common shingles agree in an entry with a chance of about J * J.
#: One changed word in 20 leaves J = 0.63 (missed by all bands in 0.1 % of cases), one in 12 J = 0.48 (11 %), one in 10 J = 0.42 (28 %).
ROWS, BANDS = 2, 40
FUNCTIONS = ROWS * BANDS
#: Entries in which candidates agree, of all. At J = 0.48 they agree in 18 on average, at J = 0.2 in 3.
LEAST_AGREED = 8
#: Bins that a text's words are counted in by their hashes, and the most that a bin holds: what is over is counted together.
#: More bins bring fewer candidates that turn out not to be similar, none of them loses a similar one.
BINS, FULL = 256, 255
#: Words whose sketches are computed at a time. Bounds the temporary arrays, not the texts.
BLOCK = 1 << 15
#: Members of a bucket that are compared with as many others at a time.
BLOCK_MEMBERS = 128
#: Ids of documents that are sent to every executor; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Words that a text holds more often than this are aligned by one mask of all their places.
OFTEN = 256
#: Length times band from which an alignment over common rare shingles is tried before the whole band.
LONG = 1 << 22


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row and the rows' places in them."""
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    places = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(places - first[:-1], count)
    more = np.concatenate([hashes, np.zeros(k, U)])
    last = np.repeat(first[1:], count)
    factors = constants(k, 3)
    total = np.zeros(len(at), U)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += np.where(at + j < last, more[at + j] * factors[j], U(0))
        return mix(total), np.append(places, len(at))


def labelled(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each shingle's hash with its number of occurrence in its row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((np.arange(len(values)), values, row))
    same = np.concatenate([[False], (values[order][1:] == values[order][:-1]) & (row[order][1:] == row[order][:-1])])
    at = np.arange(len(values))
    begun = np.maximum.accumulate(np.where(same, 0, at))
    number = np.empty(len(values), U)
    number[order] = (at - begun).astype(U)
    with np.errstate(over="ignore"):
        return np.where(number > 0, mix(values + number * U(0x9E3779B97F4A7C15)), values)


def sketches(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order MinHash: a row for each text (all of them have shingles), a column for each hash function.

    A shingle's value is the upper half of its hash, then its place: one minimum gives both.
    """
    n = len(first) - 1
    out = np.empty((n, FUNCTIONS), U)
    few = np.diff(first) < KEPT
    at = np.arange(len(keys), dtype=U)
    flips, factors = constants(FUNCTIONS, 50), constants(FUNCTIONS, 90) | U(1)
    top, upper, lower = U(0xFFFFFFFFFFFFFFFF), U(0xFFFFFFFF00000000), U(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for s in range(FUNCTIONS):
            value = keys ^ flips[s]
            value *= factors[s]
            value &= upper
            value |= at
            places = np.empty((KEPT, n), np.int64)
            for k in range(KEPT):
                places[k] = (np.minimum.reduceat(value, first[:-1]) & lower).astype(np.int64)
                if k == 0:
                    value[places[k]] = top
            places[1:, few] = places[0, few]
            places.sort(axis=0)
            entry = np.zeros(n, U)
            for k in range(KEPT):
                entry = mix(entry + keys[places[k]] * U(2 * k + 1))
            out[:, s] = entry
    return out


def binned(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words of each row are in each bin, ``FULL`` at most."""
    out = np.zeros((len(first) - 1, BINS), np.uint8)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, times = np.unique(row * BINS + (hashes & U(BINS - 1)).astype(np.int64), return_counts=True)
    out.ravel()[at] = np.minimum(times, FULL)
    return out


def signatures(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each text: its number of words, 128 bits of its word sequence, its band keys, 16 bits of each entry, its bins (zeros where it has no words)."""
    words = batch_words(texts)
    n = len(words.first) - 1
    count = np.diff(words.first).astype(np.int64)
    exact, other = np.zeros(n, U), np.zeros(n, U)
    bands, short, bins = np.zeros((n, BANDS), U), np.zeros((n, FUNCTIONS), np.uint16), np.zeros((n, BINS), np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(words.first, words.first[low] + BLOCK, "right")) - 1)
        first = words.first[low : high + 1] - words.first[low]
        some = np.flatnonzero(np.diff(first))
        if len(some):
            hashes = words.hash[words.first[low] : words.first[high]]
            first = np.append(first[:-1][some], first[-1])
            at = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
            with np.errstate(over="ignore"):
                base = powers(0xD6E8FEB86659FD93, int(np.diff(first).max()))[at]
                exact[low + some] = mix(per_row(hashes * base, first, np.add, U(0)))
                other[low + some] = mix(per_row(mix(hashes + U(1)) * base, first, np.add, U(0)))
                values, places = shingles(hashes, first)
                entries = sketches(labelled(values, places), places)
                keys = np.zeros((len(some), BANDS), U)
                for r in range(ROWS):
                    keys = mix(keys + entries[:, r::ROWS])
                short[low + some] = (entries >> U(48)).astype(np.uint16)
                bands[low + some] = mix(keys + np.arange(1, BANDS + 1, dtype=U))
            bins[low + some] = binned(hashes, first)
        low = high
    return count, exact, other, bands, short, bins


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Matched elements of the best alignment (longest common subsequence) within ``most`` diagonals of the main one.

    That is exact for an alignment that leaves at most ``most`` elements unmatched. A row of the table is one
    integer, a bit for each diagonal of the band, 0 where the row's value rises there.
    """
    short = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return -1
    same = a[:short] == b[:short]
    head = short if same.all() else int(np.argmin(same))
    a, b, short = a[head:], b[head:], short - head
    same = a[len(a) - short :][::-1] == b[len(b) - short :][::-1]
    tail = short if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    order = np.argsort(a, kind="stable")
    values, starts = np.unique(a[order], return_index=True)
    places = dict(zip(values.tolist(), np.split(order, starts[1:]), strict=True))
    masks = {v: int.from_bytes(np.packbits(a == v, bitorder="little").tobytes(), "little") for v, at in places.items() if len(at) > OFTEN}
    places = {v: at.tolist() for v, at in places.items() if v not in masks}
    wide = 2 * most + 1
    window = (1 << wide) - 1
    row, rises = window, 0
    for j, value in enumerate(b.tolist()):  # bit k of the row stands for a[j - most + k]
        low = j - most
        if j:
            rises += not row & 1
            row = (row >> 1) | (1 << (wide - 1))
        if value in masks:
            hits = masks[value] >> low if low > 0 else masks[value] << -low
            hits &= window
        else:
            hits = 0
            for at in places.get(value, ()):
                if 0 <= at - low < wide:
                    hits |= 1 << (at - low)
        if hits:
            hits &= row
            row = ((row + hits) | (row - hits)) & window
    return head + tail + rises + wide - row.bit_count()


def anchored(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Matched elements of an alignment through the shingles that each text holds once: at most as many as the best one's.

    The longest chain of such shingles in the order of both is found in n log n steps; what lies between them is aligned in bands.
    """
    found = []
    for text in (a, b):
        values, _ = shingles(text.astype(U), np.array([0, len(text)]))
        once, at, times = np.unique(values, return_index=True, return_counts=True)
        found.append((once[times == 1], at[times == 1]))
    _, left, right = np.intersect1d(found[0][0], found[1][0], assume_unique=True, return_indices=True)
    here, there = found[0][1][left], found[1][1][right]
    order = np.argsort(here)
    here, there = here[order].tolist(), there[order].tolist()
    ends, last, before = [], [], [-1] * len(there)  # the least end of a chain of each length
    for i, place in enumerate(there):
        k = bisect_left(ends, place)
        before[i] = last[k - 1] if k else -1
        ends[k : k + 1], last[k : k + 1] = [place], [i]
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append((here[i], there[i]))
        i = before[i]
    total, x, y = 0, 0, 0
    for p, q in [*reversed(chain), (len(a), len(b))]:
        if p < x or q < y:
            continue
        if p > x and q > y:
            total += max(0, aligned(a[x:p], b[y:q], min(most, max(p - x, q - y))))
        total += p < len(a)
        x, y = p + 1, q + 1
    return total


def needed(n: int | np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Words that must match in two similar texts of ``n`` words together."""
    return np.ceil(least * n / (1 + least) - 1e-9)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the words of two texts match in order for that share of all."""
    n = len(a) + len(b)
    need = int(needed(n, least))
    if min(len(a), len(b)) < need:
        return False
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    times = np.minimum(np.bincount(inverse[: len(a)], minlength=len(values)), np.bincount(inverse[len(a) :], minlength=len(values)))
    if times.sum() < need:  # no alignment matches more than the two have in common
        return False
    a, b, most = inverse[: len(a)], inverse[len(a) :], n - 2 * need
    if n * most > LONG and anchored(a, b, most) >= need:
        return True
    return aligned(a, b, most) >= need


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, exact, other, bands, sketch) of each document that has words. ``sketch``: its entries, then its bins."""

    def sign(texts: pa.Array) -> pa.Array:
        parts = [signatures(part) for part in slices(texts)]
        count, exact, other, bands, short, bins = (np.concatenate(column) for column in zip(*parts, strict=True))
        offsets = pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32))
        keys = pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))
        both = np.concatenate([short.view(np.uint8), bins], axis=1)
        data = pa.Array.from_buffers(pa.binary(both.shape[1]), len(both), [None, pa.py_buffer(both)]).cast(pa.binary())
        return pa.StructArray.from_arrays([pa.array(count), pa.array(exact.view(np.int64)), pa.array(other.view(np.int64)), keys, data], ["n", "exact", "other", "bands", "sketch"])

    kind = "struct<n: bigint, exact: bigint, other: bigint, bands: array<bigint>, sketch: binary>"
    once = F.arrow_udf(sign, kind).asNondeterministic()  # else a filter on its result computes it again, below joins
    signed = docs.select("doc_id", once("text").alias("s"))
    return signed.select("doc_id", "s.*").filter("doc_id IS NOT NULL AND n > 0")


def _sketched(sketch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of 16-bit entries, and one of bins, for each sketch of a binary array."""
    data = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(len(sketch), 2 * FUNCTIONS + BINS)
    return np.ascontiguousarray(data[:, : 2 * FUNCTIONS]).view(np.uint16), data[:, 2 * FUNCTIONS :]


def most_common(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """So many words at most can match in two texts of these numbers of words and these bins (a row each).

    In a bin no more words match than the lesser count; of what is over in full bins no more than the lesser text has of it.
    """
    over = [n - bins.sum(axis=-1, dtype=np.int64) for n, bins in ((n_a, a), (n_b, b))]
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64) + np.minimum(*over)


def _fits(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether two texts are of lengths that can be similar."""
    return np.minimum(n_a, n_b) >= SIMILARITY * np.maximum(n_a, n_b) - 1e-9


def _are_candidates() -> Column:
    """Whether the texts (n_a, sketch_a) and (n_b, sketch_b), which share a band, are candidates."""

    def agree(n_a: pa.Array, n_b: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        n_a, n_b, (left, bins_a), (right, bins_b) = n_a.to_numpy(), n_b.to_numpy(), _sketched(one), _sketched(two)
        same = (left == right).sum(axis=1) >= LEAST_AGREED
        return pa.array(same & _fits(n_a, n_b) & (most_common(n_a, n_b, bins_a, bins_b) >= needed(n_a + n_b)))

    return F.arrow_udf(agree, "boolean")("n_a", "n_b", "sketch_a", "sketch_b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar. ``texts``: (doc_id, text) of all that occur in pairs."""

    def check(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), bool)
        for low, high in cuts(left, right):  # a bounded part of the batch at a time
            one, two = batch_words(left[low:high]), batch_words(right[low:high])
            for row in range(high - low):
                out[low + row] = similar(one.hash[one.first[row] : one.first[row + 1]], two.hash[two.first[row] : two.first[row + 1]])
        return pa.array(out)

    one, two = (texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")).hint("merge") for side in ("a", "b"))  # texts are never broadcast
    both = pairs.join(one, "a").join(two, "b")
    return both.select("a", "b", F.arrow_udf(check, "boolean")("text_a", "text_b").alias("same")).filter("same").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): the least node of the component. Alternating star contraction.

    The least neighbours are written before they are joined to the links: joined to an aggregate over the same
    exchange, a star's centre with all its links would stay in one task; like this its partition can be split.
    """
    links = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")  # no centre here: a's links lead to lesser nodes
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        after = materialise(after.filter("a <> b").distinct(), "links")
        discard(links, least)
        links = after
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct candidates (a, b) whose texts are similar. Only texts that occur in them are joined to them."""
    pairs = materialise(pairs, "pairs")
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = materialise(docs.filter("text IS NOT NULL").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    links = materialise(_verified(pairs, texts).distinct(), "found")
    discard(pairs, ids, texts)
    return links


def _with_pivots(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, doc_id, band, pivot), and (bucket, n, pivot). The pivot of a bucket is the member that meets most others in all its buckets.

    So neighbouring buckets have the same pivot, and a document has few.
    """
    scores = shared.groupBy(F.col("doc_id").alias("of")).agg(F.sum("members").alias("score"))
    scored = materialise(shared.join(scores.hint("merge"), F.col("doc_id") == F.col("of")).select("bucket", "doc_id", "band", "score"), "scored")
    best = F.max(F.struct(F.col("score"), (-F.col("doc_id")).alias("id")))
    pivots = materialise(scored.groupBy("bucket").agg(F.count("*").alias("n"), best.alias("p")).select("bucket", "n", (-F.col("p.id")).alias("pivot")), "pivots")
    out = materialise(attached(scored.drop("score"), pivots, ["bucket"]), "shared")
    discard(shared, scored)
    return out, pivots


def _candidates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b), which share a band, that agree in enough entries."""
    one = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").filter(_are_candidates()).select("a", "b").distinct()


def _to_best_pivot(shared: DataFrame) -> DataFrame:
    """Each document with the pivot that it meets in most buckets."""
    met = shared.filter("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("times"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("times", "pivot")).alias("p"))
    return best.select(F.col("doc_id").alias("a"), F.col("p.pivot").alias("b"))


def _placed(shared: DataFrame, pivots: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, doc_id, band, root, pivot, pivot_root): every member of a bucket and its pivot with their components."""
    own = roots.select(F.col("node").alias("of"), "root")
    rows = materialise(shared.drop("pivot").join(own.hint("merge"), F.col("doc_id") == F.col("of"), "left").select("bucket", "doc_id", "band", F.coalesce("root", "doc_id").alias("root")), "members")
    of_pivots = materialise(pivots.join(own.hint("merge"), F.col("pivot") == F.col("of"), "left").select("bucket", "n", "pivot", F.coalesce("root", "pivot").alias("pivot_root")), "pivots")
    out = materialise(attached(rows, of_pivots, ["bucket"]), "placed")
    discard(rows, of_pivots)
    return out


def _to_other_pivots(placed: DataFrame) -> DataFrame:
    """Each document with the pivots that it meets and that are in another component than it."""
    return placed.filter("doc_id <> pivot AND root <> pivot_root").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()


def _in_blocks(own: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates among the placed members of each bucket that are in different components and none of which is its pivot; the table that they read."""
    several = own.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    several = materialise(several.select("bucket", "n", F.ceil(F.col("n") / BLOCK_MEMBERS).alias("slices")), "several")
    members = attached(own, several, ["bucket"]).filter("doc_id <> pivot").join(reps.select("doc_id", F.col("n").alias("words"), "sketch").hint("merge"), "doc_id")
    member = F.struct("doc_id", "root", "words", "sketch")
    blocks = members.groupBy("bucket", "slices", F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.col("slices")).alias("slice"))
    blocks = materialise(blocks.agg(F.first("band").alias("band"), F.collect_list(member).alias("members")), "blocks")
    discard(several)
    # both sides of a pair of blocks are dealt by the pair, so that a bucket of many blocks is in many tasks
    left = blocks.select("bucket", "band", "slice", F.explode(F.sequence(F.col("slice"), F.col("slices") - 1)).alias("other"), F.col("members").alias("left"))
    right = blocks.select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slice"))).alias("slice"), F.col("slice").alias("other"), F.col("members").alias("right"))

    def compare(band: pa.Array, same: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        out = [block_candidates(*row) for row in zip(band.to_pylist(), same.to_pylist(), left, right, strict=True)]
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    found = F.arrow_udf(compare, "array<struct<a: bigint, b: bigint>>")("band", F.col("slice") == F.col("other"), "left", "right")
    both = left.join(right, ["bucket", "slice", "other"]).select(F.explode(found).alias("p")).select("p.*")
    return both, blocks


def block_candidates(band: int, same: bool, left: pa.Scalar, right: pa.Scalar) -> list[dict[str, int]]:
    """Candidates between two blocks of a bucket, the same one perhaps, in the first band that they share."""
    one, two = left.values, right.values
    ids, others = one.field("doc_id").to_numpy(), two.field("doc_id").to_numpy()
    roots, sizes, (entries, bins) = two.field("root").to_numpy(), two.field("words").to_numpy(), _sketched(two.field("sketch"))
    out = []
    for at, (root, size, entry, own) in enumerate(zip(one.field("root").to_pylist(), one.field("words").to_numpy(), *_sketched(one.field("sketch")), strict=True)):
        low = at + 1 if same else 0
        hits = low + np.flatnonzero((roots[low:] != root) & _fits(sizes[low:], size))
        agreed = entries[hits] == entry
        first = agreed.reshape(len(hits), BANDS, ROWS).all(axis=2).argmax(axis=1)
        hits = hits[(agreed.sum(axis=1) >= LEAST_AGREED) & (first == band)]
        hits = hits[most_common(size, sizes[hits], own, bins[hits]) >= needed(size + sizes[hits])]
        out += [{"a": max(ids[at], b), "b": min(ids[at], b)} for b in others[hits].tolist()]
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): the least doc_id of its near-duplicate class, for each doc_id."""
    docs = docs.select("doc_id", "text")
    signed = materialise(_signed(docs), "signed")
    reps = signed.groupBy("exact", "other").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n", "sketch", "bands"), "doc_id").alias("s"))
    reps = materialise(reps.select("doc_id", "exact", "other", "s.*"), "reps")
    exact = reps.select("exact", "other", F.col("doc_id").alias("rep"))
    members = materialise(signed.select("doc_id", "exact", "other").join(exact, ["exact", "other"]).filter("doc_id <> rep").select("doc_id", "rep").distinct(), "members")
    entries = materialise(reps.select("doc_id", F.posexplode("bands").alias("band", "bucket")), "entries")
    buckets = materialise(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("members", F.col("n")), "buckets")
    shared = materialise(attached(entries, buckets, ["bucket"]), "shared")
    discard(signed, entries, buckets)
    shared, pivots = _with_pivots(shared)
    links = _linked(_candidates(_to_best_pivot(shared), reps), docs)
    placed = _placed(shared, pivots, components(links))
    links = links.unionByName(_linked(_candidates(_to_other_pivots(placed), reps), docs))
    discard(placed)
    placed = _placed(shared, pivots, components(links))
    more, blocks = _in_blocks(placed, reps)
    more = _linked(more.distinct(), docs)
    discard(shared, pivots, placed, reps, blocks)
    every = links.unionByName(more).unionByName(members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = components(every)
    discard(more, members)
    own = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    return own.join(final, own["doc_id"] == final["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the one of the least doc_id. Rows with a null doc_id stay."""
    classes = near_duplicates(docs).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone"))
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return both.join(classes, F.col("row.doc_id") == F.col("gone"), "left_anti").select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))
