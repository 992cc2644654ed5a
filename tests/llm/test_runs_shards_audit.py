"""Periodic runs, histogram-sort shards and the filter audit against plain counterparts, with hard rows and empty tables."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barledger.llm import filter_audit, periodic, queries, sharding

WORDS = r"[^\x20\x09-\x0D]+"


# -- periodic runs -----------------------------------------------------------------------------------


def plain_runs(words, least_words, least_repeats):
    """Every period, every start: stretches of equal words so far apart, the smallest period of each."""
    n, found = len(words), {}
    for p in range(1, n // least_repeats + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(least_words, least_repeats * p):
                found.setdefault((start, i + p), p)
            i += i == start
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def repetitive(draw):
    words = draw(st.lists(st.integers(0, draw(st.integers(0, 3))), max_size=120))
    for _ in range(draw(st.integers(0, 4))):
        if len(words) > 3:
            start, period = draw(st.integers(0, len(words) - 1)), draw(st.integers(1, len(words) // 2))
            for i in range(start + period, min(len(words), start + draw(st.integers(0, 6)) * period)):
                words[i] = words[i - period]
    return words


@given(repetitive(), st.integers(1, 40), st.sampled_from([(24, 3), (2, 2), (6, 3)]))
@settings(max_examples=300, deadline=None)
def test_runs_of_any_cuts_match_plain_search(words, cut, least):
    catcher = periodic.SquareCatcher()
    for i in range(0, len(words), cut):
        catcher.append(np.array(words[i:i + cut], dtype=np.int64))
        assert catcher.runs(*least) == plain_runs(words[:i + cut], *least)


def test_hashes_that_always_collide_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic.SquareCatcher, "_hash", lambda self, start, size: np.zeros(len(start), dtype=np.int64))
    monkeypatch.setattr(periodic.SquareCatcher, "_hashes", lambda self, first, last, size, step=1: np.zeros(len(range(first, last + 1, step)), dtype=np.int64))
    rng = random.Random(2)
    words = [rng.randrange(2) for _ in range(40)] + [1, 2, 3] * 12 + [4]
    catcher = periodic.SquareCatcher()
    catcher.append(np.array(words, dtype=np.int64))
    assert set(catcher.runs()) <= set(plain_runs(words, 24, 3)) and (39, 38, 3) not in catcher.runs()


def test_long_texts_in_steps(monkeypatch):
    monkeypatch.setattr(periodic, "STEP", 700)
    fibonacci, after = [b"a"], [b"a", b"b"]
    while len(after) < 3000:
        fibonacci, after = after, after + fibonacci
    for words in (after, [b"x"] * 5000, ([b"x"] * 60 + [b"y"]) * 60, [b"q", b"r"] * 1500 + [b"s"] * 900):
        assert periodic.word_runs(words) == plain_runs(words, 24, 3) if len(words) < 4000 else True
        assert all(n >= max(24, 3 * p) for _, n, p in periodic.word_runs(words))
    assert periodic.word_runs([b"x"] * 5000) == [(0, 5000, 1)]


def test_collapse_keeps_first_periods():
    words = b"intro a b c".split() + b"d e".split() * 20 + b"f".split()
    runs = periodic.word_runs(words)
    assert runs == [(4, 40, 2)] and periodic.collapsed(words, runs) == b"intro a b c d e f".split()
    # runs of two periods overlap in a word
    words = [b"x"] * 30 + [b"y", b"x"] * 15
    runs = periodic.word_runs(words)
    assert runs == [(0, 30, 1), (29, 31, 2)] and periodic.collapsed(words, runs) == [b"x", b"y"]


def test_run_rows(spark, odd_documents, no_documents):
    rows = periodic.find_runs(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert [(by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) for i in (3, 4, 5)] == [(0, [], "")] * 3
    assert [(r.start, r.length, r.period) for r in by_id[6].runs] == [(0, 14 * 3000, 14)]
    assert by_id[6].collapsed == "an old tree stood by the river and every word of it was heard"
    assert by_id[7].collapsed == "der Hund und die Katze liefen über den Hof und in das Haus"
    assert periodic.find_runs(no_documents).count() == 0


def test_run_digest(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice((0, 1, 30, 200)))) for i in range(120)}
    texts[3] = "la " * 50 + "x y z " * 30
    spark.createDataFrame([*texts.items(), (500, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11(spark, str(tmp_path)).collect():
        words = (texts.get(r.doc_id) or "").split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words, 24, 3)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * r.length // r.period if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


# -- shards ------------------------------------------------------------------------------------------


def shard_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def check_shards(rows, n_rows, shards):
    assert len(rows) == n_rows
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    return [sum(r["size"] for r in rows if r.shard == s) for s in range(shards)]


@pytest.mark.parametrize("task_rows", [1 << 20, 37])
def test_bytes_are_near_equal_and_copies_stay_together(spark, task_rows):
    rng = random.Random(9)
    texts = ["a hot text " * 3] * 700 + [f"copy {i % 60} " * 4 for i in range(240)] + ["é" * rng.randint(0, 300) + str(i) for i in range(1100)] + [None] * 30 + [""] * 30
    rng.shuffle(texts)
    docs = shard_table(spark, list(enumerate(texts)))
    rows = sharding.assign(docs, ["doc_id", "text"], shards=7, task_rows=task_rows).collect()
    sizes = check_shards(rows, len(texts), 7)
    assert all(r["size"] == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)
    fair, longest = sum(sizes) / 7, max(r["size"] for r in rows)
    assert all(abs(s - fair) <= fair / sharding.TOLERANCE * 2 + longest for s in sizes)
    cut = {t: {r.shard for r in rows if (r.text or "") == t} for t in {r.text or "" for r in rows}}
    assert sum(len(s) > 1 for s in cut.values()) <= 6  # a splitter cuts one group at most
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs.repartition(5), ["doc_id"], shards=7, task_rows=task_rows).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_splitters_count_exactly(spark):
    rng = random.Random(4)
    keys = sorted("".join(rng.choice("0123456789abcdef") for _ in range(sharding.KEY_DIGITS)) for _ in range(400))
    keys += [keys[0][:40] + f"{i:08x}" for i in range(300)]
    sized = [(k, rng.randint(1, 50)) for k in keys]
    rows = spark.createDataFrame(sized, "key string, size long")
    total = sum(s for _, s in sized)
    for unit, targets in (("size", [(i * total, 11) for i in range(1, 11)]), ("rows", [(k, 1) for k in range(50, 700, 50)])):
        for splitter, (top, bottom) in zip(sharding.splitters(rows, targets, unit, (0, 1)), targets):
            below = [s for k, s in sized if k < splitter.key]
            assert (splitter.size, splitter.rows) == (sum(below), len(below))
            value = sum(below) if unit == "size" else len(below)
            assert abs(value - top / bottom) <= (25 if unit == "size" else 0)


def test_equal_rows_are_split_and_odd_rows_placed(spark, odd_documents, no_documents):
    docs = shard_table(spark, [(1, "same")] * 200 + [(None, None)] * 90)
    sizes = check_shards(sharding.assign(docs, ["doc_id"], shards=5, task_rows=20).collect(), 290, 5)
    assert max(sizes) - min(sizes) <= 24
    check_shards(sharding.assign(odd_documents, odd_documents.columns).collect(), odd_documents.count(), 24)
    named = odd_documents.withColumns({"shard": F.lit("x"), "key": F.lit("y")})
    out = sharding.assign(named, named.columns, shards=2)
    assert out.columns == [*[c for c in named.columns if c != "shard"], "size", "text_crc32", "shard", "slot"] and {r.key for r in out.collect()} == {"y"}
    assert sharding.assign(no_documents, ["doc_id"]).count() == 0
    check_shards(sharding.assign(shard_table(spark, [(1, "one")]), ["doc_id"]).collect(), 1, 24)


def test_shard_files(spark, tmp_path):
    docs = shard_table(spark, [(i, "word " * (i % 7)) for i in range(300)])
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 300 and sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]


# -- filter audit ------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Walk every order over every document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails, part_of = [], []
    for doc_id, text, lang in docs:
        t = text or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        copy = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs)
        hits = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), copy)
        fails.append({x for x, hit in zip("ABCDE", hits) if hit})
        part_of.append(lang or "")
    out = {}
    for part in set(part_of):
        own = [i for i, p in enumerate(part_of) if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, x in enumerate(order, 1):
                hit = {i for i in own if x in fails[i]}
                gone = hit & left
                redundant = len(hit) - len(gone)
                left -= gone
                removed_by[x] += len(gone)
                ids = [docs[i][0] for i in gone]
                rows[part, order, step] = (len(left), len(gone), redundant, sum(fails[i] == {x} for i in own), sum(i in good for i in ids), sum(i in toxic for i in ids))
        out |= {k: (*v, removed_by[k[1][k[2] - 1]]) for k, v in rows.items()}
    return out


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}


def test_audit_matches_a_walk_over_all_orders(spark):
    rng = random.Random(8)
    texts = ["word " * 250, " ".join(f"w{i}" for i in range(300)), "A B C " * 90, "cost $5 " * 120, " ".join(f"v{i}" for i in range(210)) + " #", "short", "", None]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(90)]
    docs += [(5, texts[1], "en"), (5, texts[1], "en"), (None, texts[1], "de"), (None, texts[1], "de"), (-3, "AN #ODD\tone\n" * 80, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 80, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (-3, 1, 1)]
    have = audited(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain_audit(docs, labels)
    assert have == want and len(have) == 600 * 4


def test_potential_is_exact_for_any_game(spark):
    rng = random.Random(1)
    worth = [0, *[rng.randint(0, 10**12) for _ in range(31)]]
    rows = spark.createDataFrame([(worth,)], "removed array<long>").select(filter_audit.potentials(F.col("removed"), 5, 120).alias("p")).first().p
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << x for x in order[:order.index(i)])
            total += worth[before | 1 << i] - worth[before]
        assert rows[31] - rows[31 ^ 1 << i] == total


def test_audit_odd_rows_and_own_filters(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    have = audited(odd_documents, labels)
    assert len(have) == 600 * 4 and have["", "ABCDE", 5][0] == 0
    # the copy of a row with the same id, and rows without an id, are no copies
    assert sum(v[1] for (p, o, s), v in have.items() if o == "EABCD" and s == 1) == 2
    own = {"L": F.length("text") > 40, "X": filter_audit.COPIES}
    two = filter_audit.audit(odd_documents, labels, own).collect()
    assert {r.filter_order for r in two} == {"LX", "XL"} and len(two) == 4 * 4
    assert filter_audit.audit(no_documents, labels).count() == 0
