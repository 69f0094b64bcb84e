"""Decontamination, near duplicates, language and toxicity against brute force and planted cases."""

import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundtrace.llm import decontamination, language, near_dedup, scratch, toxicity, words
from groundtrace.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " \n\t", "!!! ...", "A", "é", "\U0001f600 x", "a\x00b", "Ab ab AB"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score string"


def plain(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, texts, first=0):
    """With columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t), "r", "z") for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def test_batch_words_are_the_words():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aB9é-\n ß.") for _ in range(rng.randrange(60))) for _ in range(300)] + ["x" * 10000 + " y" * 3000]
    batch = pa.array(["dropped", *texts])[1:]
    found = words.batch_words(batch)
    lists = [plain(t) for t in texts]
    assert np.diff(found.first).tolist() == [len(x) for x in lists]
    seen = {}
    for word, value in zip([w for x in lists for w in x], found.hash.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    assert words.batch_words(pa.array([], pa.string())).first.tolist() == [0]


def brute_contamination(text, items, window=10):
    own, hit, held = plain(text), set(), []
    for item, words_ in items:
        size = min(len(words_), window)
        grams = {tuple(words_[p : p + size]) for p in range(len(words_) - size + 1)} if size else set()
        at = [p for p in range(len(own) - size + 1) if tuple(own[p : p + size]) in grams] if size else []
        hit.update(q for p in at for q in range(p, p + size))
        if at:
            held.append(str(item))
    return len(own), len(hit), sorted(held)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, prose(rng, n, 30)) for i, n in enumerate([40, 12, 10, 9, 3, 1, 25])] + [(50, None), (51, ""), (52, "A b"), (53, "a B")]
    texts = [*ODD, "a b", prose(rng, 30, 30)]
    for _ in range(120):
        parts = [prose(rng, rng.randrange(12), 30)]
        for _ in range(rng.randrange(3)):
            own = plain(rng.choice(items)[1])
            low = rng.randrange(len(own) + 1)
            parts += [" ".join(own[low : low + rng.randrange(16)]).upper(), prose(rng, rng.randrange(4), 30)]
        texts.append("\n".join(parts))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, texts)
    expected = [brute_contamination(t, [(i, plain(x)) for i, x in items]) for t in texts]
    for block, shared in ((2_000_000, 1 << 27), (30, 1 << 27), (30, 1)):  # one automaton, many, and many in passes
        monkeypatch.setattr(decontamination, "SHARED_BYTES", shared)
        blocks = decontamination.automata(benchmark, block_words=block)
        assert (blocks.count() > 1) == (block == 30) and (len(decontamination._groups(blocks)) > 1) == (shared == 1)
        rows = decontamination.contamination(docs, blocks).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, list(r["items"])) for r in rows] == expected


def test_decontaminate_removes_spans_and_leaves_the_rest(spark, monkeypatch):
    rng = random.Random(7)
    item = prose(rng, 40)
    clean = [*ODD, prose(rng, 50, 9000)]
    texts = [*clean, f"before it. {item.upper()} After it, more words stand here", item, " ".join(item.split(" ")[:9]) + " end"]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    out = decontamination.decontaminate(documents(spark, texts), benchmark)
    assert out.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
    got = {r.doc_id: r for r in out.collect()}
    n = len(clean)
    assert [got[i].text for i in range(n)] == clean and [got[i].n_chars for i in range(n)] == [None if t is None else len(t) for t in clean]
    assert got[n].text == "before it. \n After it, more words stand here" and got[n].n_chars == len(got[n].text)
    assert n + 1 not in got and got[n + 2].text == texts[n + 2]
    other = spark.createDataFrame([(1, item), (2, prose(rng, 40)), (None, prose(rng, 12)), (3, None)], "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "SHARED_BYTES", 1)
    again = decontamination.decontaminate(documents(spark, texts), other, block_words=9)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert decontamination.decontaminate(documents(spark, texts).limit(0), benchmark).count() == 0
    assert decontamination.decontaminate(documents(spark, texts), benchmark.limit(0)).count() == len(texts)


def common_subsequence(a, b):
    """Length of the longest one, over the whole table: a bit of the row is 0 where its value rises."""
    masks = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for y in b:
        hits = row & masks.get(y, 0)
        row = ((row + hits) | (row - hits)) & whole
    return len(a) - row.bit_count()


@pytest.mark.parametrize("often", [2, 256])
def test_banded_alignment(monkeypatch, often):
    monkeypatch.setattr(near_dedup, "OFTEN", often)
    rng = np.random.default_rng(3)
    for _ in range(400):
        a = rng.integers(0, rng.integers(1, 30), rng.integers(1, 40))
        b = list(a)
        for _ in range(rng.integers(0, 6)):
            at = int(rng.integers(0, len(b) + 1))
            b = b[:at] + ([int(rng.integers(0, 30))] if rng.random() < 0.5 else []) + b[at + int(rng.random() < 0.5) :] or [0]
        b, most = np.array(b), int(rng.integers(0, 12))
        best, got = common_subsequence(a.tolist(), b.tolist()), near_dedup.aligned(a, b, most)
        assert got <= best
        if len(a) + len(b) - 2 * best <= most:
            assert got == best


def brute_classes(texts):
    """The least number of each text's class, by the longest common subsequence of the words of every pair."""
    from collections import Counter

    grams = [plain(t) for t in texts]
    bags = [Counter(x) for x in grams]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and find(i) != find(j):
                m = (bags[i] & bags[j]).total()  # no subsequence is longer
                if m / (len(a) + len(b) - m) >= 0.8:
                    m = common_subsequence(a, b)
                if m / (len(a) + len(b) - m) >= 0.8:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return [find(i) for i in range(len(texts))]


def near_copies():
    """Exact and near copies in groups, a passage that many share, a text in another order, odd texts."""
    rng = random.Random(11)
    texts = [*ODD, "one two", "one TWO", "one three"]
    for size in (1, 3, 8, 30):
        base = plain(prose(rng, rng.choice((60, 90)), 5000))
        for k in range(size):
            own = list(base)
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own) + "." * (k % 2))
    passage = prose(rng, 40, 5000)
    texts += [f"{prose(rng, 15, 5000)} {passage} {prose(rng, 15, 5000)}" for _ in range(40)]
    chain = plain(prose(rng, 80, 5000))
    for k in range(12):  # neighbours are similar, the ends are not
        chain = chain[7:] + plain(prose(rng, 7, 5000))
        texts.append(" ".join(chain))
    blocks = [prose(rng, 20, 5000) for _ in range(4)]
    return [*texts, " ".join(blocks), " ".join(blocks[::-1])]


@pytest.mark.parametrize(("members", "groups"), [(128, 10_000), (3, 10**9)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, members, groups):
    """Neither the size of blocks nor how hot buckets are joined changes a class."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(scratch, "HOT_ROWS", 1 if groups > 10_000 else scratch.HOT_ROWS)
    monkeypatch.setattr(scratch, "HOT_GROUPS", groups)
    texts = near_copies()
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = near_dedup.drop_near_duplicates(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == documents(spark, []).columns


def test_op2_finds_the_near_copies_of_the_table(spark):
    """The registered query against all pairs of the smallest table: none too many, nine of ten links at least."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    expected = brute_classes([r.text for r in rows])
    out = QUERIES["op2_near_dedup"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "class_id", "kept"]
    got = {r.doc_id: r.class_id for r in out.collect()}
    place = {r.doc_id: i for i, r in enumerate(rows)}
    linked = [i for i in range(len(rows)) if expected[i] != i]
    found = [i for i in linked if got[rows[i].doc_id] != rows[i].doc_id]
    assert linked and len(found) >= 0.9 * len(linked)
    assert all(expected[place[c]] == expected[place[d]] for d, c in got.items())


def test_alignment_over_rare_shingles():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = rng.integers(0, 200, rng.integers(1, 90))
        b = np.delete(a, rng.integers(0, len(a), len(a) // 9))
        b[rng.random(len(b)) < 0.05] = 777
        assert near_dedup.anchored(a, b, len(a) + len(b)) <= common_subsequence(a.tolist(), b.tolist())
    long = rng.integers(0, 50_000, 400_000)
    changed = long.copy()
    changed[rng.random(len(long)) < 0.04] = 99_999
    assert near_dedup.anchored(long, changed, 80_000) >= 0.95 * len(long)
    assert near_dedup.similar(long, changed) and not near_dedup.similar(long, rng.permutation(long)[:300_000])


def test_near_duplicates_of_odd_tables(spark):
    docs = documents(spark, [])
    assert near_dedup.near_duplicates(docs).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, None), (2, "A b c d e f!"), (None, "a b c d e f"), (3, None), (4, None)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(odd).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert near_dedup.drop_near_duplicates(odd).count() == 6


def test_bins_bound_the_words_in_common():
    """The bound holds for every pair of texts, full bins included, and no similar pair fails it."""
    rng = np.random.default_rng(6)
    for k in range(300):
        n = int(rng.integers(1, 1500))
        hashes = words.mix(rng.integers(0, rng.integers(1, 6) if k % 3 == 0 else 500, n).astype(np.uint64))
        other = np.where(rng.random(n) < rng.random() / 4, words.mix(rng.integers(0, 900, n).astype(np.uint64)), hashes)[rng.integers(0, 9) :]
        if not len(other):
            continue
        bins = [near_dedup.binned(x, np.array([0, len(x)])) for x in (hashes, other)]
        bound = near_dedup.most_common(n, len(other), *bins)[0]
        values, inverse = np.unique(np.concatenate([hashes, other]), return_inverse=True)
        assert bound >= np.minimum(np.bincount(inverse[:n], minlength=len(values)), np.bincount(inverse[n:], minlength=len(values))).sum()
        assert bound >= near_dedup.needed(n + len(other)) or not near_dedup.similar(hashes, other)


def test_texts_around_a_passage_are_not_compared_in_pairs(spark, monkeypatch):
    """A passage of two thirds of each text puts them into common buckets; their number of alignments doesn't grow with its square."""
    rng = random.Random(13)
    passage, compared, verified = prose(rng, 100, 10**6), [], near_dedup._verified
    texts = [f"{prose(rng, 25, 10**6)} {passage} {prose(rng, 25, 10**6)}" for _ in range(60)]
    texts.append(texts[7].replace(plain(texts[7])[40], "changed"))
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, own: compared.append(pairs.count()) or verified(pairs, own))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {**{i: i for i in range(60)}, 60: 7}
    assert sum(compared) < len(texts)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    found = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ROOTS = {"en": ["the", "and", "ing", "tion"], "de": ["ung", "sch", "keit", "ein"], "fr": ["eau", "ment", "oi", "que"]}


def spoken(rng, name, n):
    return " ".join("".join(rng.choice(ROOTS[name]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_profiles(spark):
    rng = random.Random(17)
    rows = [(i, spoken(rng, n, 40), n) for i, n in enumerate(list(ROOTS) * 40)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = language.learn(labelled, "text", "lang")
    assert profiles.languages == sorted(ROOTS)
    texts = [spoken(rng, n, 30) for n in ROOTS] + [None, "", "123 !?"]
    got = [tuple(r.g) for r in documents(spark, texts).select("doc_id", language.language(spark, profiles, "text").alias("g")).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [*ROOTS, "und", "und", "und"] and all(0 <= g[1] <= 1 for g in got)
    nothing = language.learn(labelled.limit(0), "text", "lang")
    assert language.classify("some text", language.alphabet(), nothing) == ("und", 0.0)


def test_out_of_place_distance():
    letters = language.alphabet()
    values, counts = language.counted("abca Äb", letters)
    assert counts[values == ord("a")] == [2] and counts[values == ord("ä")] == [1]
    assert language.ranked(np.array([1, 3, 3]), np.array([7, 9, 8]), 2).tolist() == [8, 9]


def test_grams_are_counted_by_parts(monkeypatch):
    letters = language.alphabet()
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("ab é1 -\n") for _ in range(rng.randrange(40)))
        plain_text = " " + " ".join(re.findall(r"[^\W\d_]+", text)) + " "
        expected = {}
        for n in (1, 2, 3):
            for i in range(len(plain_text) - n + 1):
                gram = plain_text[i : i + n]
                if gram.strip() and not (n == 3 and gram[1] == " "):
                    expected[gram] = expected.get(gram, 0) + 1
        for part in (1, 2, 7, 1 << 17):
            monkeypatch.setattr(language, "PART", part)
            values, counts = language.counted(text, letters)
            got = {}
            for value, count in zip(values.tolist(), counts.tolist(), strict=True):
                signs = []
                while value:
                    signs.append(chr(value & 0x1FFFFF))
                    value >>= 21
                got["".join(signs[::-1])] = count
            assert got == (expected if plain_text.strip() else {})


def test_op3_equals_brute_force(spark):
    """The registered query against profiles by counters, on the smallest table."""
    from collections import Counter

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()

    def profile(texts):
        total = Counter()
        for text in texts:
            own = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
            total.update(own[i : i + n] for n in (1, 2, 3) for i in range(len(own) - n + 1) if own[i : i + n].strip() and not (n == 3 and own[i + 1] == " "))
        value = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
        return sorted(total, key=lambda g: (-total[g], value(g)))[: language.TOP]

    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    names = sorted({r.lang for r in rows if r.lang is not None and not held[r.doc_id]})
    ranks = {n: {g: k for k, g in enumerate(profile(r.text for r in rows if r.lang == n and not held[r.doc_id]))} for n in names}
    out = QUERIES["op3_language"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    for r in rows:
        own = profile([r.text])
        far = {n: sum(abs(ranks[n].get(g, 10**9) - k) if g in ranks[n] else language.TOP for k, g in enumerate(own)) for n in names}
        best = min(names, key=lambda n: (far[n], n)) if own else "und"
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].held_out == held[r.doc_id] and 0 <= got[r.doc_id].score <= 1


def test_bounded_samples_are_stable(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    first = sorted(r.doc_id for r in language.bounded(rows, "doc_id", "label", 100).collect())
    assert 120 < len(first) < 280 and first == sorted(r.doc_id for r in language.bounded(rows, "doc_id", "label", 100).collect())


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(19)
    bad = ["scumbag", "lowlife"]
    texts, marks = [], []
    for i in range(700):
        own = [f"{rng.choice('abcdefgh')}{rng.randrange(300)}w" for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(bad) + rng.choice(["", "er", "es", f"{rng.randrange(99)}"]))
        texts.append(" ".join(own))
        marks.append((i, int(toxic)))
    docs = documents(spark, texts + ODD)
    labels = spark.createDataFrame([(i, None, t) for i, t in marks] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.scored(docs, labels).select("row.doc_id", F.col("score")).collect()
    score = {r[0]: r[1] for r in rows}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((score[i] >= 0.5) == bool(dict(marks)[i]) for i in held)
    assert right >= 0.97 * len(held) and all(0 <= v <= 1 for v in score.values())
    assert len({score[700 + ODD.index(t)] for t in (None, "", " \n\t", "!!! ...")}) == 1 and score[700] < 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(v < 0.5 for v in score.values())
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_pooling_is_by_blocks(monkeypatch):
    rng = np.random.default_rng(23)
    first = np.array([0, 0, 5, 5, 300, 301])
    ids = rng.integers(0, 50, (301, toxicity.COLUMNS)).astype(np.int32)
    embedding = rng.normal(size=(50, toxicity.DIMENSIONS)).astype(np.float32)
    filters = rng.normal(size=(toxicity.DIMENSIONS, sum(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32)
    bias = {w: np.zeros(toxicity.FILTERS, np.float32) for w in toxicity.WIDTHS}
    whole = toxicity.pooled(ids, first, embedding, filters, bias)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(whole, toxicity.pooled(ids, first, embedding, filters, bias), atol=1e-4)


def test_words_are_numbered_in_order():
    rng = np.random.default_rng(41)
    for n in (0, 1, 2, 500):
        known = np.unique(np.concatenate([rng.integers(0, 1 << 32, n), 7 * (1 << 20) + rng.integers(0, 4 * n + 1, n), [0, 2**32 - 1][:n]]).astype(np.uint32))
        asked = np.concatenate([known, known + np.uint32(1), known - np.uint32(1), rng.integers(0, 1 << 32, 100, np.uint32)])
        place = {x: k for k, x in enumerate(known.tolist(), 1)}
        got = toxicity.numbered(known, asked.reshape(-1, 1), toxicity.spread(known))
        assert got.shape == (len(asked), 1) and got.ravel().tolist() == [place.get(x, 0) for x in asked.tolist()]


def test_toxicity_learns_from_every_word_of_every_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 1 << 17)
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    rng = random.Random(29)
    texts = []
    for _ in range(40):
        own = [f"w{rng.randrange(300)}x" for _ in range(12000)]
        own[74] = "marker"
        texts.append(" ".join(own))
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    model, again = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7), labels)
    wanted = toxicity.hashed(words.batch_words(pa.array(["marker " + " ".join(f"w{i}x" for i in range(300))])).hash)
    assert np.isin(wanted, model.words).all()
    assert np.array_equal(model.embedding, again.embedding) and np.array_equal(model.thresholds, again.thresholds)


def test_shards_are_stored_in_parts(spark, monkeypatch):
    """No stored row is as large as a shard, and parts change nothing that is learned."""
    monkeypatch.setattr(toxicity, "SHARD", 1 << 14)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rng = random.Random(31)
    docs = documents(spark, [" ".join(f"w{rng.randrange(300)}x" for _ in range(rng.randrange(400))) for _ in range(200)])
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    materialise, models, stored = toxicity.materialise, [], []

    def watched(df, label, **options):
        out = materialise(df, label, **options)
        if label in ("shards", "numbered"):
            stored.append([(r.shard, len(r.ids)) for r in out.collect()])
        return out

    monkeypatch.setattr(toxicity, "materialise", watched)
    for part in (toxicity.PART, 500):
        monkeypatch.setattr(toxicity, "PART", part)
        models.append(toxicity.learn(docs, labels))
    assert all(len(rows) == len({shard for shard, _ in rows}) > 1 for rows in stored[:2])
    assert all(len(rows) > 10 and max(size for _, size in rows) <= 500 * 4 * toxicity.COLUMNS for rows in stored[2:])
    assert all(sum(size for _, size in rows) == sum(size for _, size in stored[0]) for rows in stored)
    assert np.array_equal(models[0].embedding, models[1].embedding) and np.array_equal(models[0].thresholds, models[1].thresholds)


def test_learning_leaves_little_on_disk(spark, monkeypatch):
    """Words are stored packed, training needs one table of them, and shuffle files go with their query, not with the driver's garbage."""
    monkeypatch.setattr(toxicity, "SHARD", 1 << 15)
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    rng = random.Random(37)
    docs = documents(spark, [" ".join(f"w{rng.randrange(5000)}x" for _ in range(1500)) for _ in range(120)])
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(120)], "doc_id bigint, quality int, toxic int")
    blocks, folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager(), Path(scratch.scratch_dir(spark).removeprefix("file://"))
    there, materialise, trained, sizes, kept = set(folder.iterdir()), toxicity.materialise, toxicity._trained, {}, []

    def shuffled():
        return {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}

    def stored(df, label, **options):
        out = materialise(df, label, **options)
        sizes[label] = sum(x.stat().st_size for new in folder.glob(f"{label}-*") if new not in there for x in new.glob("*.parquet"))
        return out

    def train(shards, number, n):
        kept.extend([number, *(x.name.split("-")[0] for x in folder.iterdir() if x not in there)])
        return trained(shards, number, n)

    monkeypatch.setattr(toxicity, "materialise", stored)
    monkeypatch.setattr(toxicity, "_trained", train)
    before = shuffled()
    assert toxicity.learn(docs, labels) is not None
    n = 1500 * sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(120))
    assert kept[0] > 1 and kept[1:] == ["numbered"] and set(folder.iterdir()) == there
    assert all(sizes[k] < 6 * n for k in ("labelled", "shards", "numbered")), (n, sizes)
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
