"""Document operators against plain counterparts, with hard rows and empty tables."""

import hashlib
import math
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barledger.llm import langid, media, mixing, packing, secrets, simhash, toxicity


def by_id(df):
    return df.collect()


# -- near-duplicates ---------------------------------------------------------------------------------


def test_fingerprint_of_words():
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \t\n\x0b\x0c\r") == 0
    assert simhash.fingerprint(b"One  TWO\nthree") == simhash.fingerprint(b"one two three") == brute.fingerprint("one two three")
    text = "a b c d e f g a b c d e f g Été x"
    assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


@given(st.lists(st.integers(0, 63), max_size=4, unique=True), st.integers(0, 2**64 - 1))
@settings(max_examples=200, deadline=None)
def test_every_link_meets_in_a_key(bits, fp):
    other = fp
    for b in bits:
        other ^= 1 << b
    same, one_off = simhash.chain_keys()
    x = np.array([fp ^ other], dtype=np.uint64)
    assert any(not (fp ^ other) & mask and len(simhash.chain_test(x, start)) for start, mask in same + one_off)


def test_components_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    fps, base = [], [int(x) for x in rng.integers(0, 2**63, 12)]
    for b in base:
        for _ in range(30):
            for _ in range(int(rng.integers(0, 7))):
                b ^= 1 << int(rng.integers(0, 64))
            fps.append(b)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f, f) for f in set(signed)], "fp long, label long")
    same, one_off = simhash.chain_keys()
    links = simhash.key_links(rows, same + one_off).collect()
    want = brute.classes([f % 2**64 for f in set(signed)], lambda a, b: (a ^ b).bit_count() <= 4)
    got = brute.united(set(signed), [(r.a, r.b) for r in links])
    assert sorted(sorted(x % 2**64 for x in c) for c in got) == sorted(sorted(c) for c in want)


def test_components_of_a_long_path(spark):
    from barledger.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0]
    assert components(edges.where("false")).count() == 0


def test_simhash_hard_rows(spark, odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    found = {r.doc_id: r for r in rows}
    assert found[2].component_id == 1 and found[4].component_id == found[5].component_id == 3 and found[3].fp == 0
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    assert ids == [(False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (False, 9), (True, None)]
    assert simhash.near_duplicates(no_documents).count() == 0 and simhash.keep_one(no_documents).count() == 0


def test_every_component_keeps_a_row_though_ids_repeat(spark):
    one, two = "a first text about rivers and boats that go down to the sea", "quite another text on bread and salt in an old kitchen"
    rows = [(1, one), (1, two), (1, two), (2, one), (3, two), (None, "third text with no id at all and no copy")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (1, two), (0, rows[-1][1])])


# -- secrets -----------------------------------------------------------------------------------------

PIECES = ["token", "password", "api_key", "API-KEY", "=", ": ", '"', "'", " ", "\n", "AKIA", "ABCDEFGH23456789", "deadbeef", "0123456789abcdef", "x", "abc", "\U0001f600", "é", "==", "secret"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_base_spans_match_plain_search(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find(docs).collect():
        got = [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3]
        assert got == brute.base_secrets(texts[r.doc_id]), texts[r.doc_id]


def test_weak_parts_need_each_other(spark):
    value = "Zk3" + "aB9x" * 6
    alone, near, far = f"here is {value} only", f"user: alice99 and {value} at https://api.example.com/v1", f"user: alice99 {'word ' * 200} {value}"
    docs = spark.createDataFrame([(1, alone), (2, near), (3, far), (4, "https://api.example.com/v1 user: bob")], "doc_id long, text string")
    found = {r.doc_id: [(secrets.KINDS[s.kind], near[s.start:s.end]) for s in r.spans] for r in secrets.find(docs).collect()}
    assert found[1] == found[3] == found[4] == []
    assert found[2] == [("identifier", "user: alice99"), ("value", value), ("endpoint", "https://api.example.com/v1")]


def test_secret_hard_rows(odd_documents, no_documents):
    rows = secrets.digest(secrets.find(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    nine = next(r for r in rows if r.doc_id == 9)
    assert (nine.n_assign, nine.n_access, nine.n_hex) == (2, 1, 1)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in rows if r.doc_id in (3, 4, 5, None))
    masked = secrets.masked(odd_documents)
    assert masked.columns == odd_documents.columns and masked.count() == odd_documents.count()
    text = next(r.text for r in masked.collect() if r.doc_id == 9)
    assert text == f"{secrets.MARK} \U0001f600 {secrets.MARK} {secrets.MARK} {secrets.MARK}"
    assert secrets.find(no_documents).count() == 0 and secrets.masked(no_documents).count() == 0


# -- mixture -----------------------------------------------------------------------------------------


def test_targets_fill_up_to_the_limit(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, None: 5, "d": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = brute.targets(sizes, (5, 2, 1), 3)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in got)


def test_mix_takes_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = mixing.mix(docs).toPandas(), mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert first[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    for _, group in first.groupby("source", dropna=False):
        assert abs(group.taken.sum() - group.target.iloc[0]) <= 1
    assert (first.taken <= 3 * first["size"]).all()
    out = mixing.mixed_documents(docs)
    words = out.select(mixing.words(out["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert words == first.taken.sum()


def test_mix_hard_rows(odd_documents, no_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.taken == 0 and r.size == 0 for r in rows if r.doc_id in (3, 4, 5))
    out = mixing.mixed_documents(odd_documents)
    assert out.columns == odd_documents.columns
    total = out.select(mixing.words(out["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert total == sum(r.taken for r in rows)
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_documents(no_documents).count() == 0


# -- packing -----------------------------------------------------------------------------------------


def fewest_bins(items, capacity):
    """Exact optimum by trying every place of every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@given(st.sampled_from([7, 10, 23]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
@settings(max_examples=150, deadline=None)
def test_small_packings_are_optimal(case):
    capacity, items = case
    plan = packing.bin_completion({x: items.count(x) for x in items}, capacity)
    assert sum(n for _, n in plan) == (fewest_bins(items, capacity) if items else 0)


def test_short_pieces_fill_bins_with_any_number_of_pieces():
    rng = np.random.default_rng(0)
    for lo, hi, most in ((60, 146, 10), (20, 100, 1), (1, 3, 0)):
        sizes = rng.integers(lo, hi + 1, 20_000).tolist()
        counts = {x: sizes.count(x) for x in set(sizes)}
        bins = sum(n for _, n in packing.bin_completion(counts, 1024))
        assert bins - packing.lower_bound(counts, 1024) <= most <= sum(n for _, n in packing.best_fit(counts, 1024)) - packing.lower_bound(counts, 1024)
    every = {1: 5000, 7: 3}
    assert sum(n for _, n in packing.bin_completion(every, 1024)) == packing.lower_bound(every, 1024)


def test_fillings_are_undominated_and_complete():
    def plain(room, counts):
        lengths, out = sorted(counts, reverse=True), []

        def go(i, left, chosen):
            if i == len(lengths):
                out.append((left, tuple(chosen)))
                return
            for k in range(min(left // lengths[i], counts[lengths[i]]), -1, -1):
                go(i + 1, left - k * lengths[i], [*chosen, (lengths[i], k)] if k else chosen)

        go(0, room, [])
        full = [(left, f) for left, f in out if all(x > left or dict(f).get(x, 0) == n for x, n in counts.items())]
        return min(full)[0], {f for _, f in full}

    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(2, 30, 5)}
        room = int(rng.integers(5, 60))
        least, full = plain(room, counts)
        found = list(packing.fillings(room, sorted(counts, reverse=True), counts))
        assert set(found) <= full and room - sum(x * k for x, k in found[0]) == least


def test_bin_completion_is_a_packing():
    rng = np.random.default_rng(5)
    for capacity, n in ((1024, 300), (100, 60), (50, 25), (1024, 4000)):
        counts = {}
        for x in rng.integers(1, capacity, n):
            counts[int(x)] = counts.get(int(x), 0) + 1
        plan = packing.bin_completion(counts, capacity)
        used = {}
        for filling, bins in plan:
            assert sum(x * k for x, k in filling) <= capacity
            for x, k in filling:
                used[x] = used.get(x, 0) + k * bins
        assert used == counts
        assert packing.lower_bound(counts, capacity) <= sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, capacity))
    assert packing.bin_completion({}, 10) == []


def test_bin_completion_beats_best_fit_where_it_can():
    counts = {6: 1, 5: 1, 4: 2, 3: 3}  # 28 of 10: best fit may need four bins, three hold all
    plan = packing.bin_completion(counts, 10)
    assert sum(n for _, n in plan) == 3


def test_pieces_and_ids(spark):
    from tokenizers import Tokenizer

    vocabulary, _ = packing.default_paths()
    slow = Tokenizer.from_file(vocabulary)
    texts = ["", "word " * 1500, "mixed 中文 text", "<|endoftext|> inside", "café naïve x\x1cy", "a" * 3000, "tab\tand\r\nlines  here "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        for start, length, crc in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(ids[start:start + length].tobytes()) == crc
        assert (own.length.iloc[1:] == 1024).all()
    assert gapless(rows)


def gapless(rows):
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        ends = group.length.cumsum()
        if group.offset.tolist() != [0, *ends.tolist()[:-1]] or ends.iloc[-1] > 1024:
            return False
    return True


def test_pack_hard_rows(odd_documents, no_documents):
    rows = packing.pack(odd_documents).toPandas()
    assert gapless(rows) and (rows[rows.doc_id == 3].length == 1).all() and len(rows[rows.doc_id == 7]) == 2
    assert packing.pack(no_documents).count() == 0


# -- mixing keys of all weights --------------------------------------------------------------------


def test_slices_are_small_for_every_weight(spark):
    n = 20_000
    u = (np.arange(n) + 0.5) / n
    for weight in (mixing.LEAST_WEIGHT, 0.2, 0.5, 1.0):
        keys = spark.createDataFrame([(float(-math.log(x) / weight),) for x in u], "key double")
        rows = keys.select("key", mixing.key_slice(F.col("key"), 200).alias("slice")).orderBy("key").collect()
        slices = [r.slice for r in rows]
        assert slices == sorted(slices) and max(slices) < 200 and np.bincount(slices).max() <= n * 1.9 / 200


def test_weight_does_not_need_spaces(spark):
    texts = ["the cat sat on the mat", "\u732b\u5750\u5728\u57ab\u5b50\u4e0a" * 20, "#### ---- 1234", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.quality(F.col("text")).alias("w")).collect()
    assert [round(r.w, 6) for r in rows] == [1.0, 1.0, 0.1, 0.1, 0.1]


# -- language ----------------------------------------------------------------------------------------


def language_rows(spark, n=80):
    words = {"en": "the and of to in that is was for on are with as be at this".split(), "de": "der die und das ist nicht von mit sich auf für ein dem über".split(), "fr": "le la les des est que une dans pour pas sur qui au avec ère".split()}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(np.resize(sorted(words), n).tolist())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_unseen_rows(spark):
    docs = language_rows(spark)
    held = langid.held_out(docs["doc_id"])
    found = langid.predict(docs.where(held), langid.train(docs.where(~held))).collect()
    assert found and all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in found)


def test_elastic_net_is_sparse_and_counts_are_whole():
    at, n = langid.bucket_counts("ab" * 5000)
    long_at, long_n = langid.bucket_counts("ab" * 1_000_000)
    assert n.sum() == 3 * 10002 - 3 and long_n.sum() == 3 * 2_000_002 - 3 and set(at) == set(long_at)
    rows = [(np.array([0, 1]), np.array([1.0, 0.001]), 0), (np.array([2]), np.array([1.0]), 1)] * 20
    weights, _ = langid.fit_ftrl(lambda: rows, 2, 10, l1=0.5)
    assert weights[0, 0] > 0 and not weights[1].any() and not weights[5].any()


def test_language_hard_rows(spark, odd_documents, no_documents):
    model = langid.train(odd_documents)
    rows = langid.predict(odd_documents, model)
    assert rows.columns == [*(c for c in odd_documents.columns if c != "score"), "lang_pred", "score", "rarity"]
    found = rows.collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in found if r.doc_id in (3, 4, 5, 8))
    assert all(r.lang_pred in ("en", "de", "fr") and 0 <= r.score <= 1 for r in found if r.doc_id in (1, 6, 7))
    assert langid.train(no_documents) is None and langid.predict(no_documents, None).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_documents, None).collect()} == {"und"}
    assert langid.accepted(odd_documents).columns == odd_documents.columns and langid.accepted(no_documents).count() == 0


def test_model_decides_which_documents_stay(spark):
    odd = [(1000, "zqx zqx xqz", "en"), (1001, "123", "en"), (1002, None, "en"), (1003, "der die und das ist nicht von mit sich auf", None)]
    docs = language_rows(spark).union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    marked = {r.doc_id: (r.lang_pred, r.score, r.rarity) for r in langid.predict(docs, model).collect()}
    kept = {r.doc_id for r in langid.accepted(docs).collect()}
    assert 0 < model.least_score <= langid.HIGHEST_LIMIT and marked[1000][2] > model.most_rarity
    fit = {i for i, (lang, score, rare) in marked.items() if lang != "und" and score >= model.least_score and rare <= model.most_rarity}
    assert kept == fit == {*range(80), 1003}
    german = {r.doc_id for r in langid.accepted(docs, ["de"]).collect()}
    assert german == {i for i, (lang, *_) in marked.items() if lang == "de" and i in kept} and 1003 in german and len(german) < 40
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in langid.accepted(unlabelled).collect()} == {*range(80), 1000, 1003}


def test_many_labels_are_all_learned(spark):
    """Every label has a word of its own; the sample is shared evenly and no label is left out."""
    rng = np.random.default_rng(3)
    names = [f"l{i:03d}" for i in range(120)]
    word = {n: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7)) for n in names}
    rows = [(i, f"{word[n]} {word[n]} {word[n]}{i % 7}", n) for i, n in enumerate(names * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == names
    assert all(r.lang == r.lang_pred for r in langid.predict(docs, model).collect())
    assert 100 < langid.sample(docs, 1000, 240).count() < 400


def test_features_are_the_same_read_again(spark):
    chosen = language_rows(spark)
    idf = np.ones(langid.BUCKETS)
    one, two = (list(langid.Features(chosen.repartition(n), keep).rows(idf, False)) for n, keep in ((1, 1 << 30), (5, 0)))
    assert len(one) == 64 and all(a[2] == b[2] and (a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(one, two))


def test_prediction_matches_a_plain_regression(spark):
    """The whole prediction by dictionaries: n-grams, document frequencies, all classes in every step, temperature by trial."""
    docs = language_rows(spark, 60)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    order = [r.doc_id for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("place")).orderBy("place").collect()]
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.train(docs)).collect()}
    want = brute.language_regression(rows, order, {i: langid.bucket_counts(t) for i, t, _ in rows})
    assert all(found[i][0] == want[i][0] and abs(found[i][1] - want[i][1]) < 0.02 for i in found)


def test_every_labelled_row_is_learned(spark, monkeypatch):
    """Several blocks: all rows are dealt, rare languages to every block, the model does not depend on the layout of the table."""
    monkeypatch.setattr(langid, "BLOCK_ROWS", 100)
    monkeypatch.setattr(langid, "LEAST_ROWS", 12)
    docs = language_rows(spark, 600).union(spark.createDataFrame([(2000 + i, f"zqx qqx xqz {i % 3} jj", "zz") for i in range(4)], "doc_id long, text string, lang string"))
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    dealt = langid.deal(docs, counts, 6, 4).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("place").alias("rows"), F.countDistinct("block").alias("blocks"))
    assert {r.lang: (r.n, r.rows, r.blocks) for r in dealt.collect()} == {"de": (200, 200, 6), "en": (200, 200, 6), "fr": (200, 200, 6), "zz": (24, 4, 6)}
    monkeypatch.setattr(langid, "sample", None)  # nothing is drawn
    one, two = langid.train(docs), langid.train(docs.orderBy(F.desc("doc_id")).repartition(3))
    assert one.languages == two.languages == ["de", "en", "fr", "zz"] and (one.weights == two.weights).all() and one.temperature == pytest.approx(two.temperature)
    assert all(r.lang == r.lang_pred for r in langid.predict(docs, one).collect())


# -- toxicity ----------------------------------------------------------------------------------------


@given(st.lists(st.integers(-12, 12).map(lambda x: x / 4), max_size=12), st.sampled_from([-0.5, -1.0]))  # exact in binary
@settings(max_examples=200, deadline=None)
def test_segments_are_maximal(scores, other):
    places = [i for i, s in enumerate(scores) if s > 0.1]
    flat = [s if s > 0.1 else other for s in scores]
    got = sorted((lo, hi) for _, lo, hi in toxicity.segments(places, [scores[i] for i in places], len(scores), other))
    assert got == sorted(brute.maximal_segments(flat))


def toxic_table(spark, make, n=600, share=2):
    """Every ``share``-th text toxic; (docs, labels of the first two thirds)."""
    rng = np.random.default_rng(6)
    rows = [(i, make(rng, i % share == 0)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, int(i % share == 0)) for i in range(n * 2 // 3)], "doc_id long, quality int, toxic int")


def test_toxic_words_inside_clauses_without_spaces(spark):
    letters = [chr(0x4e00 + i) for i in range(300)]

    def make(rng, toxic):
        clauses = ["".join(rng.choice(letters, 12)) for _ in range(6)]
        if toxic:
            at = int(rng.integers(2, 9))
            clauses[3] = clauses[3][:at] + "\u8822\u8d27\u6eda" + clauses[3][at:]
        return "\uff0c".join(clauses)

    docs, labels = toxic_table(spark, make)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r.doc_id >= 400}
    assert all(v < 0.5 for i, v in scored.items() if i % 2) and sum(v >= 0.5 for i, v in scored.items() if not i % 2) > 95


def test_nothing_learned_means_nothing_toxic(spark):
    copies, labels = toxic_table(spark, lambda rng, toxic: "one text that says this" if toxic else "another text that says that")
    assert all(r.score < 0.5 for r in toxicity.score(copies, toxicity.train(copies, labels)).collect())
    noise, labels = toxic_table(spark, lambda rng, toxic: " ".join(rng.choice([f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"], 40)))
    assert sum(r.score >= 0.5 for r in toxicity.score(noise, toxicity.train(noise, labels)).collect() if r.doc_id >= 400) <= 10


def test_scores_match_a_plain_scorer(spark):
    """The whole score by loops: tokens, log-odds looked up, all segments by trial, chance law, logistic."""
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeio" for c in "lmnr"]
    docs, labels = toxic_table(spark, lambda rng, toxic: " ".join([*rng.choice(words, 14), *(["vilest", "Vileness"] if toxic else [])]), share=3)
    lexicon = toxicity.train(docs, labels)
    for r in toxicity.score(docs.limit(60), lexicon).collect():
        scores = []
        for w in r.text.lower().split():
            known = [lexicon.words[w]] if w in lexicon.words else [lexicon.prefixes[w[:n]] for n in (4, 5, 6) if len(w) > n and w[:n] in lexicon.prefixes]
            scores.append(max(known, default=lexicon.other))
        spans = [(sum(scores[lo:hi]), lo, hi) for lo, hi in brute.maximal_segments(scores)]
        chance = {x: lexicon.scale * len(scores) * math.exp(-lexicon.decay * x[0]) for x in spans}
        good = [x for x in spans if chance[x] <= 0.5]
        logit = lexicon.slope * min(60.0, sum(-math.log(max(chance[x], 1e-26)) for x in good)) + lexicon.offset
        assert math.isclose(r.score, 1 / (1 + math.exp(-logit)), rel_tol=1e-6)
        assert sorted((p.start, p.end) for p in r.passages) == sorted((lo, hi) for _, lo, hi in good)


def test_toxic_words_are_learned(spark):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(60)]
    plain = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(200)]
    bad = ["zzbadword", "zzuglyword"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 60))
        if i % 4 == 0:
            words[10:10] = [bad[i % 8 // 4]] * 2
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, known)).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored if r.doc_id >= 400]
    assert sum(right) >= 0.97 * len(right)
    assert any(r.passages for r in scored if r.doc_id % 4 == 0)


def test_toxicity_hard_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1), (None, 1, 1), (99, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.train(odd_documents, labels)
    rows = toxicity.score(odd_documents, lexicon)
    assert rows.count() == odd_documents.count() and all(0 <= r.score <= 1 for r in rows.collect())
    nothing = toxicity.train(no_documents, labels.where("false"))
    assert toxicity.score(no_documents, nothing).count() == 0
    assert all(r.score < 0.5 for r in toxicity.score(odd_documents, nothing).collect())


# -- media -------------------------------------------------------------------------------------------


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(data):
    filled = media.payload(data)
    assert len(filled) % media.ROW == 0 and filled[:len(data)] == data and len(filled) >= max(len(data), 1)
    assert media.decode_png(media.encode_png(filled)).tobytes() == filled


def test_png_of_many_rows():
    filled = media.payload(b"some words that repeat " * 100_000)
    assert len(filled) > media._ROWS * media.ROW and media.decode_png(media.encode_png(filled)).tobytes() == filled


@pytest.mark.parametrize("kind", range(5))
def test_every_row_filter(kind):
    rng = np.random.default_rng(kind)
    samples = rng.integers(0, 256, (6, 12), dtype=np.uint8)
    lines = brute.png_filtered(samples, kind, 3)
    assert (media.unfilter(np.full(6, kind, dtype=np.uint8), lines, 3) == samples).all()


def test_damage_is_found():
    whole = media.encode_png(media.payload(b"some text"))
    for broken in (whole[:-5], whole[:50] + bytes([whole[50] ^ 1]) + whole[51:], b"x" + whole[1:]):
        with pytest.raises(ValueError):
            media.decode_png(broken)


def test_media_hard_rows(odd_documents, no_documents):
    rows = media.features(media.media_column(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    found = {r.doc_id: r for r in rows}
    assert found[3].payload_bytes == found[4].payload_bytes == 192 and found[3].feature == found[4].feature
    assert found[1].media_sha256 == found[2].media_sha256
    data = media.payload(found[9].text.encode())
    assert found[9].payload_sha256 == hashlib.sha256(data).hexdigest() and found[9].tail_crc32 == zlib.crc32(data[-16:])
    assert media.features(media.media_column(no_documents)).count() == 0
