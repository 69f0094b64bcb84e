"""Line runs, mixing, preferences and secrets against brute force."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from groundtrace.llm import line_dedup, mixing, preferences, scratch, secrets
from groundtrace.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def plans_without_python(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def brute_lines(docs, least):
    """doc_id -> kept lines, by looking at every run of every pair of places."""
    order = sorted(docs)
    count = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    filled = {d: [x for x in docs[d].split("\n") if count(x)] for d in order}
    gone = {d: set() for d in order}
    places = [(d, i) for d in order for i in range(len(filled[d]))]
    for at, (d, i) in enumerate(places):
        for e, j in places[:at]:
            length = total = 0
            while i + length < len(filled[d]) and j + length < len(filled[e]) and filled[d][i + length] == filled[e][j + length]:
                total += count(filled[d][i + length])
                length += 1
            if total >= least:
                gone[d].update(range(i, i + length))
    out = {}
    for d in order:
        n = -1
        lines = []
        for x in docs[d].split("\n"):
            n += bool(count(x))
            if not (count(x) and n in gone[d]):
                lines.append(x)
        out[d] = (len(filled[d]), len(gone[d]), "" if gone[d] and len(gone[d]) == len(filled[d]) else "\n".join(lines))
    return out


@pytest.mark.parametrize(("least", "groups"), [(1, 10_000), (5, 10_000), (9, 10_000), (9, 10**9)])
def test_line_runs_equal_brute_force(spark, monkeypatch, least, groups):
    monkeypatch.setattr(scratch, "HOT_ROWS", 1 if groups > 10_000 else scratch.HOT_ROWS)
    monkeypatch.setattr(scratch, "HOT_GROUPS", groups)  # of so many every group is broadcast
    rng = random.Random(least)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6))) for _ in range(12)] + ["", "   ", "\t\r", "a b c d e f g h i j k", "a\tb\x0bc  d", "a" + 9 * " " + "b\r"]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for i in range(60)}
    docs[60], docs[61], docs[62] = "", docs[3], "a a a\na a a\na a a\na a a"
    rows = line_dedup.split_lines(spark.createDataFrame(sorted(docs.items()), "doc_id bigint, text string"), least)
    got = {r[0]: (r[1], r[2], r[3]) for r in rows.select("row.doc_id", "n_lines", "n_deleted", F.array_join("kept", "\n")).collect()}
    assert got == brute_lines(docs, least)


def test_dedup_lines_on_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(2, f"{passage}\nrest", 7), (1, passage, 7), (1, passage, 7), (None, passage, 7), (3, None, 7), (4, "", 7), (5, passage, 7), (6, f"{passage} \nx", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").withColumn("spans", F.lit(1)).withColumn("row", F.lit(2))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text, r.n_chars) for r in out.filter("text IS NOT NULL").collect())
    assert got == [(0, passage, 7), (1, passage, 7), (1, passage, 7), (2, "rest", 4), (4, "", 7), (6, f"{passage} \nx", None)]
    assert out.filter("text IS NULL").count() == 1 and line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert plans_without_python(out)


def test_texts_of_one_doc_id_are_documents_of_their_own(spark):
    run = "\n".join(f"line {i} of ten" for i in range(15))
    docs = spark.createDataFrame([(1, f"{run}\none"), (1, f"{run}\ntwo"), (1, f"{run}\ntwo"), (2, run)], "doc_id bigint, text string")
    got = sorted(((r.row.doc_id, r.row.text[-3:], r.n_deleted) for r in line_dedup.split_lines(docs).collect()), key=str)
    kept = {(d, t) for d, t, n in got if not n}
    assert len(got) == 4 and len(kept) == 1 and kept < {(1, "one"), (1, "two")} and {n for _, _, n in got} <= {0, 15}


def test_ranks_follow_the_order_of_the_suffixes(spark):
    """Ranks by 2**k lines against the sorted prefixes of all suffixes that have a twin."""
    rng = random.Random(3)
    docs = {i: [rng.choice(["a b", "c d e", "f", "g h"]) for _ in range(rng.randrange(5, 12))] for i in range(12)}
    frame = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id bigint, text string")
    _, ranks, _ = line_dedup.suffix_ranks(line_dedup.numbered_lines(frame, 8).cache(), 8)
    found = {}
    for r in ranks.collect():
        found.setdefault(r.k, {}).setdefault(r.rank, set()).add(tuple(docs[r.doc_id][r.pos : r.pos + 2**r.k]))
    order = {next(iter(v))[0]: rank for rank, v in found[0].items()}
    for k, groups in found.items():
        assert all(len(v) == 1 and len(next(iter(v))) == 2**k for v in groups.values())
        sorted_ = [next(iter(groups[rank])) for rank in sorted(groups)]
        assert sorted_ == sorted(sorted_, key=lambda prefix: [order[x] for x in prefix])
    assert max(found) >= 2


def levels(sizes):
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        for s in over or open_:
            out[s] = 2 * sizes[s] if over else share[s]
            left -= out[s]
        open_ -= over or open_
    return out


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("x" * rng.randrange(1, 4) for _ in range(rng.choice((0, 1, 9, 40)))), rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(900)]
    rows += [(5, "again and again", "a"), (5, "again and again", "a"), (None, "no id", "b"), (7000, None, "none"), (7001, "", "none"), (7002, "\t \x0b\x0c\r\n\x85 y", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("weight", F.lit(1)).withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id bigint, quality int")
    out = mixing.mixed(docs, labels)
    assert plans_without_python(out)
    got = out.collect()
    again = mixing.mixed(docs.repartition(7), labels).collect()
    key = lambda r: str((r.doc_id, r.source, r.tie, r.size, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = levels(sizes)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and abs(r.target - expected[source]) < 1e-6 and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - expected[source]) <= 0.5 + 1e-9
        if expected[source] >= sizes[source]:
            assert all(r.taken >= r.size for r in own)
    assert mixing.mixed(docs, None).count() == len(rows) and mixing.mixed(docs.limit(0), labels).count() == 0


def test_weights_matter(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = mixing.mixed(docs, labels).filter("source = 'a' AND taken % 2 = 0").join(labels, "doc_id").groupBy("quality").agg(F.avg("taken")).collect()
    mean = dict(tuple(r) for r in rows)
    assert mean[1] > mean[0]


def test_ranges_don_t_change_the_mix(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = sorted(tuple(r) for r in mixing.mixed(docs, None).select("doc_id", "taken").collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(tuple(r) for r in mixing.mixed(docs, None).select("doc_id", "taken").collect()) == whole


def test_preferences(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>"), (1, 2, "assistant", "hello"), (1, 3, "user", "more"), (1, 4, "assistant", "yes"),
        (2, 0, "system", "be kind"), (2, 1, "user", "hi <|end|>"), (2, 2, "assistant", "no"), (3, 0, None, None), (4, 0, None, None), (None, 0, "user", "lost"),
    ]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("pair_id", F.lit(9))
    pairs = spark.createDataFrame([(10, 1, 2), (11, 3, 4), (12, 1, 99), (13, 1, 1), (14, None, 2)], "pair_id bigint, chosen_id bigint, rejected_id bigint")
    out = preferences.format_preferences(table, pairs)
    assert plans_without_python(out)
    got = {r.pair_id: r for r in out.collect()}
    first = got[10]
    assert first.n_common == 2 and first.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi <​|end|><|end|>\n"
    assert first.chosen == "<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\nyes<|end|>\n" and first.rejected == "<|assistant|>\nno<|end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in first.chosen_mask.split(",")]
    assert [first.chosen[a:b] for a, b in spans] == ["hello<|end|>\n", "yes<|end|>\n"] and first.rejected_mask == "14:24"
    assert (got[11].n_common, got[11].prompt, got[11].chosen) == (1, "<|user|>\n<|end|>\n", "")
    assert (got[12].n_common, got[12].prompt, got[12].rejected) == (0, "", "") and got[12].chosen
    assert (got[13].n_common, got[13].chosen, got[13].chosen_mask) == (5, "", "") and got[14].chosen == ""
    assert preferences.format_preferences(table.limit(0), pairs).count() == 5


def test_pairs_of_large_ids(spark, tmp_path):
    """Conversations above 2**53 keep their own partners, negative ids and odd roles too."""
    turns = []
    for first in (2**60, 2**60 + 2, 2**62 - 4, 0, -2, 8):
        for conv in (first, first + 1):
            turns += [(conv, 0, "user<|end|>\n<", f"hi <| {first}"), (conv, 1, "assistant", f"answer {conv}")]
    turns = [t for t in turns if t[0] != 9]  # 8 has no partner
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["op8_preferences"](spark, str(tmp_path))
    got = {r.pair_id: (r.chosen_id, r.rejected_id, r.n_common, r.chosen) for r in out.collect()}
    firsts = (2**60, 2**60 + 2, 2**62 - 4, 0, -2)
    assert got == {f // 2: (f, f + 1, 1, f"<|assistant|>\nanswer {f}<|end|>\n") for f in firsts}
    assert {r.prompt.count("<|") for r in out.collect()} == {2}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    names = ", ".join(sorted(out.columns))
    assert sorted(map(str, (tuple(r) for r in out.select(sorted(out.columns)).collect()))) == sorted(map(str, db.sql(f"SELECT {names} FROM ({ORACLE_SQL['op8_preferences']})").fetchall()))


def test_secrets(spark):
    rng = random.Random(4)
    digest = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = []
    for i in range(400):
        kind = i % 4
        texts.append({0: f'words token = "{digest()}" more', 1: f"call {rng.randrange(10**15, 10**16)} now", 2: f"see https://www.example.com/archive/2024/item-{i} there", 3: "nothing here"}[kind])
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (900, None), (901, ""), (902, "a\tb"), (903, texts[4]), (903, texts[4])], "doc_id bigint, text string").withColumn("word", F.lit("x"))
    found = secrets.findings(docs)
    labelled = found.filter(secrets.learned_from()).withColumn("label", secrets.rule_label())
    out = secrets.scored(found, labelled)
    assert plans_without_python(found)
    rows = out.collect()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert len(held) == 300 and all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert len({r.score for r in rows if r.doc_id == 903}) == 1
    assert secrets.scored(found, labelled.filter("label = 1")).select("score").distinct().collect()[0][0] == 1.0
    assert secrets.scored(found, labelled.limit(0)).select("score").distinct().collect()[0][0] == 0.0


def secret_forms(rng):
    """name -> (how one is written, labels of the rules, whether it is a secret)."""
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper, tens = "0123456789abcdef", "0123456789ABCDEF", "123456789"
    base64 = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    mixed = lambda n: draw(base64, n - 3) + "aB7"
    return {
        "lower": (lambda: f'token = "{draw(lower, 40)}"', {1}, True),
        "upper": (lambda: f'TOKEN = "{draw(upper, 40)}"!!', {1}, True),
        "glued": (lambda: f'API_KEY="{draw(lower, 40)}"', {1}, True),
        "single quotes": (lambda: f"token: '{draw(lower, 32)}'", {1}, True),
        "unquoted": (lambda: f"token = {draw(lower, 39)}7", {1}, True),
        "base64": (lambda: f'secret = "{mixed(40)}"', {1}, True),
        "key format": (lambda: f'token = "AKIA{draw("ABCDEFGHIJ234567", 16)}"', {1}, True),
        "bare key format": (lambda: f"use ghp_{mixed(36)} there", {1}, True),
        "24 digits": (lambda: f'secret = "{draw(lower, 23)}7"', {None}, True),
        "number": (lambda: f"call {draw(tens, 16)} now", {0}, False),
        "mail": (lambda: f"ask jane.{draw(tens, 2)}@mail8.example.com now", {0}, False),
        "address": (lambda: f"see https://www.example.com/archive/2024/item-{draw(tens, 3)} there", {0}, False),
        "path": (lambda: f"open /srv/data/{draw('aeioulmnrst', 7)}/part-{draw(tens, 3)}.csv then", {0}, False),
        "uuid": (lambda: f"row {draw(lower, 8)}-{draw(lower, 4)}-{draw(lower, 4)}-{draw(lower, 4)}-{draw(lower, 11)}1 done", {0}, False),
        "commit": (lambda: f"commit {draw(lower, 39)}7 merged", {0}, False),
    }


def test_forest_on_held_out_findings_of_all_kinds(spark):
    """Labels by the rules on four of five documents; precision and recall on the others, forms without a label among them."""
    rng = random.Random(8)
    forms = secret_forms(rng)
    names = [*forms]
    texts = [f"some words {forms[names[i % len(names)]][0]()} more" for i in range(80 * len(names))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.findings(docs)
    judged = found.withColumn("label", secrets.rule_label())
    told = {n: set() for n in names}
    for r in judged.collect():
        told[names[r.doc_id % len(names)]].add(r.label)
    assert told == {n: labels for n, (_, labels, _) in forms.items()}
    known = secrets.dictionary(docs)
    assert "words" in known and "archive" in known and len(known) <= secrets.DICTIONARY_WORDS
    rows = secrets.scored(found, judged.filter(secrets.learned_from()), known).filter(~secrets.learned_from()).collect()
    hits = [(forms[names[r.doc_id % len(names)]][2], r.score >= 0.5) for r in rows]
    right = sum(a and b for a, b in hits)
    assert len(rows) > 200 and right >= 0.95 * sum(b for _, b in hits) and right >= 0.95 * sum(a for a, _ in hits)


def test_candidates_that_a_name_assigns(spark):
    texts = ["password: hunter", 'the pwd = "correct-horse" x', "SECRET=abcdefg now", "password: abc", "a password of sorts here", "key://nothing-here", "monkey business 12345"]
    rows = secrets.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.word) for r in rows) == [(0, "hunter"), (1, "correct-horse"), (2, "SECRET=abcdefg")]


def test_op5_on_the_smallest_table(spark, tmp_path):
    """The registered query's columns against a plain search of the texts; an empty table has no findings."""
    import hashlib
    import zlib

    out = QUERIES["op5_secrets"](spark, SMALL)
    rows = out.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    expected = set()
    for doc, text in texts.items():
        for n, word in enumerate(re.sub(r"[\x09-\x0D]", " ", text or "").split(" ")):
            bare = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", word)
            if len(bare) >= 16 and re.search("[0-9]", bare):
                expected.add((doc, n, hashlib.sha256(bare.encode()).hexdigest(), len(bare), zlib.crc32(str(doc).encode()) % 5 == 0))
    got = {(r.doc_id, r.word_no, r.word_sha256, r.length, r.held_out) for r in rows}
    assert expected <= got and all(0 <= r.score <= 1 and r.is_secret == (r.score >= 0.5) for r in rows)
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op5_secrets"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    rows = QUERIES[name](spark, SMALL)
    own = sorted(map(str, (tuple(r) for r in rows.select(sorted(rows.columns)).collect())))
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    names = ", ".join(sorted(rows.columns))
    assert own == sorted(map(str, db.sql(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall()))


def test_line_dedup_joins_documents_alike_at_every_size(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, "a b")], "doc_id bigint, text string")
    plan = line_dedup.split_lines(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
