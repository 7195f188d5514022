"""Corpus operators against SQL, brute force and held-out labels, and on odd tables."""

from __future__ import annotations

import os
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from llm import brute
from vitalframe.llm import classlm, common, components, decontaminate, induced, langid, linededup, minhash, mixing, mtree, substrings, toxicity, unitdedup
from vitalframe.llm.registry import registry

REGISTRY = registry()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_equals_sql(spark, con, sf, name):
    equal, message = oracle.compare(spark, con, sf, *REGISTRY[name])
    assert equal, message


def test_languages_held_out(spark, sf):
    got = REGISTRY["op1_langid"][0](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert len(held) > 30
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_mixed_languages_are_spans(spark):
    en, fr = "the of and thing with that this from", "les des une dans pour avec être même"
    train = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr")] * 5)]
    model = langid.train(spark.createDataFrame(train, DOCS))
    text = f"{en} {en}. {fr} {fr}"
    got = langid.label(spark.createDataFrame([(1, text, None, None, None), (2, "привет 12", None, None, 0), (3, " 12 ", None, None, 0)], DOCS), model)
    got = {r.doc_id: r for r in got.collect()}
    assert [(text[s.first : s.end].split()[0], s.lang) for s in got[1].spans] == [("the", "en"), ("les", "fr")]
    assert got[2].lang_pred in ("en", "fr") and got[3].lang_pred == "und" and got[3].score == 0


def test_paths_equal_a_plain_viterbi():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(0, 9, 5)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(0, 5, (bounds[-1], 3)).astype(np.float32)
        model = langid.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.ones((1, 3), bool))
        path = model.paths(scores, bounds)
        for a, b in zip(bounds[:-1], bounds[1:]):
            total = [0.0] * 3
            for t in range(a, b):
                total = [max(total[p] - (langid.SWITCH if p != k and t > a else 0) for p in range(3)) + scores[t, k] for k in range(3)]
            mine = sum(scores[t, path[t]] for t in range(a, b)) - langid.SWITCH * (path[a:b][1:] != path[a:b][:-1]).sum()
            if b > a:
                assert abs(mine - max(total)) < 1e-3


def test_leaks_equal_brute_force(spark, sf, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # a copy with one word changed and a text shorter than the item
    w = items[0][1].split()
    extra = [(90001, "x y z " + " ".join([*w[:10], "changed", *w[11:]]) + " q r"), (90002, " ".join(w[:-2]))]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows + extra], DOCS)
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.leaks(rows + extra, items)
    assert set(got) == set(want) and len(got) >= 3
    for key, (s, p) in want.items():
        assert got[key][0] == pytest.approx(s) and got[key][1] == p


def test_leaks_of_short_items_and_small_pieces_of_long_texts(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Forty two"), (2, "a b c d e f g")], "item_id long, text string")
    rows = [(10, " forty  TWO "), (11, "forty two three"), (12, "so forty two it is then"), (13, "x " * 40 + "a b c d e f g" + " y" * 40), (14, None), (15, "two")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    want = {(10, 1, 1.0, 0, 2), (13, 2, 1.0, 40, 7)}
    for windows in (1 << 12, 3):
        monkeypatch.setattr(decontaminate, "WINDOWS", windows)
        assert {tuple(r) for r in decontaminate.leaks(docs, items).collect()} == want


def test_long_regular_words_are_told_apart():
    bits = np.array([bin(i).count("1") & 1 for i in range(2048)])
    data = np.concatenate([97 + bits, 98 - bits]).astype(np.uint8)
    cuts = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(common.range_hashes(common.prefix_sums(data), *cuts).tolist())) == 1
    assert len(set(common.word_hashes(data, *cuts).tolist())) == 2


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    data = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 12))) for i in range(40)]
    index = decontaminate.build_index(data)
    for _ in range(200):
        value = int(index.prints[rng.integers(40)])
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            value ^= 1 << int(bit)
        want = [i for i, p in enumerate(index.prints) if bin(int(p) ^ value).count("1") <= decontaminate.RADIUS]
        assert index.within(value, 12).tolist() == want


def test_substrings_equal_brute_force(spark, sf, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in REGISTRY["op5_substrings"][0](spark, sf).collect()}
    assert got == brute.repeats(rows)


def test_crowded_anchor_is_split(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    shared = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(30)) + " " + shared[: 150 + 3 * i] + " " + " ".join(word() for _ in range(30))) for i in range(40)]
    rows += [(100, "ab" * 300), (101, "x" * 250)]
    monkeypatch.setattr(substrings, "CROWD", 3)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 5000)
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.substring_report(docs).collect()}
    assert got == brute.repeats(rows)


def test_little_but_repeats_is_sorted():
    rng = random.Random(21)

    def noise(k: int) -> bytes:
        return bytes(rng.randrange(97, 123) for _ in range(k))

    passages = [noise(size) for size in (80, 120, 199, 200, 260, 420)]
    texts = [noise(rng.randrange(150, 400)) + passages[k % 6] + noise(rng.randrange(150, 400)) for k in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    _, low, n, anchor, key, _ = substrings.anchors(data, np.cumsum([0, *map(len, texts)]))
    often = np.isin(key, [k for k in set(key.tolist()) if (key == k).sum() > 1])
    low, n, at, key = low[often], n[often], (anchor - low)[often], key[often].view(np.int64)
    strings = [data[a : a + c + substrings.SPAN - 1] for a, c in zip(low, n)]
    text, base = np.concatenate(strings), np.cumsum([0, *map(len, strings)])[:-1]
    piece, first, count = substrings.may_repeat(text, base, key, n, at, np.ones(len(n), bool))
    line, head = substrings.shard_line(text, base[piece], at[piece], first, count)
    order, shared = induced.suffix_array(line)
    same = shared > substrings.SPAN - substrings.GRAM
    hit = set(order[same | np.append(same[1:], False)].tolist())
    found = {int(low[p] + f + k) for p, f, c, h in zip(piece, first, count, head) for k in range(c) if h + k in hit}
    windows = [data[w : w + substrings.SPAN].tobytes() for w in range(len(data) - substrings.SPAN + 1)]
    twice = Counter(windows)
    assert found == {w for w in range(len(windows)) if twice[windows[w]] > 1}
    assert 0 < len(line) < 0.6 * len(text)
    alone = substrings.may_repeat(text, base, key, n, at, np.zeros(len(n), bool))
    assert len(alone[0]) == 0 and len(substrings.shard_line(text, base[:0], at[:0], *alone[1:])[0]) == 1


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(1)
    for turn in range(80):
        n, k = int(rng.integers(1, 200)), int(rng.choice([2, 3, 30, 300]))
        text = rng.integers(1, k + 1, n)
        text = np.append([text, np.tile(text[:7], 60), np.repeat(text, 3)][turn % 3], 0)
        order, shared = induced.suffix_array(text)
        plain = text.tolist()
        want = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert order.tolist() == want
        for r in range(1, len(plain)):
            a, b, same = want[r - 1], want[r], 0
            while same < induced.CAP and max(a, b) + same < len(plain) and plain[a + same] == plain[b + same]:
                same += 1
            assert shared[r] == same


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # one vector very often
    rows += [(2000, None), (2100, [0.1, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (2400, [0.5, 0.25]), (None, rows[0][1]), (2500, [])]
    got: dict = {}
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    # the operator sees single precision
    seen = [(r.vec_id, r.embedding) for r in frame.collect()]
    for r in mtree.top_k(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in brute.best(seen).items() if v}
    assert got == want


def test_trees_skip_distances():
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 400, (20, 16))
    points = np.floor(np.repeat(centre, 150, axis=0) + rng.normal(0, 5, (3000, 16))).astype(np.int64)
    ids = np.arange(3000)
    tree = mtree.ready(mtree.build_tree(ids, points, float((points.astype(float) ** 2).sum(axis=1).max())))
    scores = points @ points[0]
    want = np.lexsort((ids, -scores))
    found, value = mtree.search(tree, points[0], -1, 10)
    assert found.tolist() == want[:10].tolist() and value.tolist() == scores[want[:10]].tolist()
    assert tree["leaf"].sum() >= 3000 / mtree.PAGE


def test_top_k_of_repeated_rows_and_lengths_equals_sql(spark, tmp_path):
    rows = [(0, [0.5, 0.25]), (1, [0.3, 0.1]), (1, [0.3, 0.1]), (1, [0.7, 0.1]), (2, [0.5]), (3, [0.2, 0.2]), (100, [9.0]), (100, [8.0])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    equal, message = oracle.compare(spark, con, str(tmp_path), *REGISTRY["op6_topk"])
    assert equal, message
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nothing_is_rejected_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None, 0), (None, "d", None, None, 0)], DOCS)
    assert toxicity.clean(docs, spark.createDataFrame([], LABELS)).count() == 2
    assert toxicity.clean(docs, spark.createDataFrame([(1, 0, 1)], LABELS)).count() == 2


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """Texts of any length, all labels of a kind and all shards; of repeated ids one row, and equal weights in every run."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 900)
    docs = [(i, "calm words " * 20 if i % 2 else "calm words " * 2050 + "vile slur", None, None, 0) for i in range(60)]
    docs += [(i, f"calm words {i}", None, None, 0) for i in range(60, 4500)] + [(1, "calm words again", None, None, 0)]
    docs = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, 0, int(i < 60 and i % 2 == 0)) for i in range(4500)], LABELS)
    rows = toxicity.training_rows(docs, labels)
    known = labels.filter(common.remainder(labels.doc_id, 5) != 0)
    assert rows.count() == known.count() > 3000
    assert rows.select("shard").distinct().count() > 1
    first, again = (toxicity.train(docs, labels, epochs=2) for _ in range(2))
    assert first.learned and (first.flat() == again.flat()).all() and (first.thresholds == again.thresholds).all()


def test_training_leaves_no_broadcast_files(spark, sf):
    def files() -> int:
        return len(os.listdir(spark.sparkContext._temp_dir))

    before = files()
    model = toxicity.train(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")), epochs=2)
    assert model.learned and files() == before


def test_small_sources_meet_their_target(spark):
    docs = [(1000 * s + i, "w " * words, None, f"s{s}", 0) for s, (n, words) in enumerate([(5, 20), (25, 20), (100, 20), (100, 100), (400, 900)]) for i in range(n)]
    for r in mixing.mix_sources(spark.createDataFrame(docs, DOCS)).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target + 1


def test_near_duplicates_equal_brute_force(spark, sf, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in REGISTRY["op7_minhash"][0](spark, sf).collect()}
    assert got == brute.near(rows)


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[i * 2 : i * 2 + 60])) for i in range(30)]  # neighbours are alike, ends are not
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == {(d, c) for d, (_, c) in brute.near(rows).items()}



def test_near_copies_edited_apart_are_not_verified(spark, monkeypatch):
    """Copies of one text at similarity 0.66 to each other agree in many min-hashes; they are told apart before full sets meet."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for d in range(40):
        own = list(base)
        for i in rng.choice(np.arange(0, 50), 6, replace=False) * 6:
            own[i] = f"own{d}x{i}"
        texts.append(" ".join(own))
    texts.append(texts[7].replace("w299", "other"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, whole = [], minhash.confirmed

    def confirmed(pairs, sets):
        met.append(pairs.count())
        return whole(pairs, sets)

    monkeypatch.setattr(minhash, "confirmed", confirmed)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {d: c for d, (_, c) in brute.near(list(enumerate(texts))).items()}
    assert got[40] == 7 and max(met) < 100  # 780 pairs in all, of which some 4% are at 0.73 to 0.75


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 8, 140, 141, 900, 5000):
        grams = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2)
        for apart in sorted({0, n // 8, n // 7, n // 7 + 1}):  # shingles of the first set that the second lacks
            sets = [np.sort(grams[:n]), np.sort(grams[apart:n])]
            words = minhash.parities(np.concatenate(sets), np.array([0, n, n + len(sets[1])]))
            odd = sum(int(x).bit_count() for x in words[0] ^ words[1])
            assert odd <= apart and (odd - apart) % 2 == 0
            if 100 * (n - apart) >= 75 * n:
                assert odd * 175 <= (2 * n - apart) * 25


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {x: x for pair in links for x in pair}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    alone = {x for x in parent if all(x not in pair or pair[0] == pair[1] for pair in links)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: top(x) for x in parent if x not in alone}


def test_few_links_take_no_rounds(spark, monkeypatch):
    rng = random.Random(12)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)] + [(9000 + k, 9001 + k) for k in range(400)]
    table = spark.createDataFrame(links, "u long, v long").repartition(7).cache()
    written = []
    plain = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or plain(df, name))
    once = components.components(table).orderBy("node").collect()
    assert written == ["links", "stars"]
    monkeypatch.setattr(components, "LINKS", 100)
    assert components.components(table).orderBy("node").collect() == once
    assert "large" in written
    assert {r.component for r in once if r.node >= 9000} == {9000}


def test_forms_joined_by_shuffle_find_the_same_links(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 3 = 0")
    few = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "FORMS", 0)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == few


def test_mix_is_near_its_targets_and_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = mixing.mix_sources(docs).orderBy("doc_id").collect()
    assert a == mixing.mix_sources(docs.repartition(7)).orderBy("doc_id").collect()
    whole = sum(r["size"] for r in a)
    for source in {r.source for r in a}:
        own = [r for r in a if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=0.02 * own[0].target + 30)
        assert own[0].target <= 2 * own[0].source_size
        assert all(r.taken <= 2 * r["size"] for r in own)
    assert sum(r.taken for r in a) == pytest.approx(1.5 * whole, rel=0.01)


def test_quotas_are_highest_quotients(spark):
    rng = random.Random(8)
    votes = [(g, k, rng.choice([0, 3, 7, 50, 900])) for g in range(12) for k in range(9)]
    house = {g: rng.choice([0, 1, 5, 40, 333]) for g in range(12)}
    frame = spark.createDataFrame([(g, k, float(v), house[g]) for g, k, v in votes], "g int, k int, votes double, house long")
    got = {(r.g, r.k): r.seats for r in mixing.apportion(frame, ["g"], ["k"]).collect()}
    for g in range(12):
        seats = {k: 0 for k in range(9)}
        mine = {k: v for h, k, v in votes if h == g}
        for _ in range(house[g] if any(mine.values()) else 0):
            best = max((k for k in mine if mine[k] > 0), key=lambda k: (mine[k] / (2 * seats[k] + 1), -k))
            seats[best] += 1
        assert {k: got[(g, k)] for k in range(9)} == seats


def test_toxicity_held_out(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = REGISTRY["op9_toxicity"][0](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_language_model(spark, sf, rows):
    got = {r.doc_id: r for r in REGISTRY["op10_classlm"][0](spark, sf).collect()}
    want = brute.unigrams(rows)
    assert set(got) == set(want)
    for d, (held, tokens, known, total, base) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_adds_up_to_one(spark):
    texts = ["a b a c", "b a c a b", "c a b", "a a b d e f g"] * 4
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    model, vocabulary = classlm.train(docs)
    room = 10**model.room
    held = {r.ending: 0 for r in vocabulary.collect()}
    place = {int(w): p for w, p in zip(model.head.words, model.head.place)}
    shares = np.zeros(len(room))
    for r in vocabulary.collect():
        p = place[r.word % (1 << 64)]
        shares[model.of[p if p >= 0 else classlm.CLUSTERED + r.ending]] += r.n + 1
    for ending in held:
        shares[model.of[classlm.CLUSTERED + ending]] += 1  # unseen words
    used = shares > 1
    assert np.allclose(shares[used], room[used])
    assert np.allclose((10**model.steps).sum(axis=1), 1)


@pytest.mark.parametrize("head", [classlm.HEAD, 540])
def test_words_that_are_not_frequent_are_clustered_too(spark, monkeypatch, head):
    monkeypatch.setattr(classlm, "HEAD", head)
    # 510 frequent words, of which 30 stand inside texts and 30 alone; 80 rarer ones of one ending do the same
    fill = [(i, " ".join([*(f"f{j}" for j in range(448)), *(f"d p{j} e" for j in range(30))]), None, None, None) for i in range(60)]
    fill += [(100 + i % 30, f"q{i % 30}", None, None, None) for i in range(1800)]
    inside = [(1000 + i, " ".join([f"d a{i}zz e"] * 30), None, None, None) for i in range(40)]
    alone = [(2000 + i % 40, f"b{i % 40}zz", None, None, None) for i in range(1200)]
    docs = spark.createDataFrame(fill + inside + alone, DOCS)
    _, _, rows = classlm.fitted(docs, docs, False)
    rows = rows.filter("doc_id >= 1000").collect()
    first = {c for r in rows if r.doc_id < 2000 for c in r.line[1:-1:3]}
    second = {r.line[0] for r in rows if r.doc_id >= 2000}
    assert not first & second and max(first | second) < classlm.CLASSES


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(9)
    kind = rng.integers(0, 3, 30)
    pairs = np.array([[rng.poisson(20 if (kind[a] + 1) % 3 == kind[b] else 1) for b in range(30)] for a in range(30)])
    of = classlm.exchange(np.pad(pairs, (0, 1)), 30, 3)
    assert len({(a, b) for a, b in zip(kind, of[:30])}) == 3


# --- odd tables ------------------------------------------------------------------------------------

LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 3),
    (4, "one two", "fr", None, 7),
    (5, "one two", "fr", "a", 7),
    (6, "The same words in a line of text that is repeated\nOther words here to fill one more line", "en", "b", 1),
    (6, "The same words in a line of text that is repeated\nOther words here to fill one more line", "en", "b", 1),
    (7, "THE SAME words in a line of text that is repeated", None, "b", 1),
    (None, "a text without an id but with more than five words", "en", "b", 1),
    (None, None, None, None, None),
    (8, LONG, "en", "b", len(LONG)),
    (9, "12 34 !!", "de", "c", 8),
    (10, "ünïcode text with ñ and ß in it 漢字 слово", "de", "c", 8),
]


def _docs(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({c: F.lit("x") for c in ("key", "size", "uid", "node", "line_no", "n", "score", "taken", "_c", "rank")})


def _apply(spark):
    labels = spark.createDataFrame([(2, 1, 0), (6, 1, 1), (99, 0, 1), (None, 1, 1), (4, None, None), (8, 0, 0)], LABELS)
    bench = spark.createDataFrame([(1, ODD[5][1]), (2, None), (3, ""), (4, "two words"), (None, ODD[8][1])], "item_id long, text string")
    return {
        "langid": langid.identify,
        "lines": linededup.line_report,
        "drop_lines": linededup.drop_lines,
        "leaks": lambda d: decontaminate.leaks(d, bench),
        "without_leaks": lambda d: decontaminate.without_leaks(d, bench),
        "substrings": substrings.substring_report,
        "units": unitdedup.repeated_units,
        "drop_units": unitdedup.drop_units,
        "near": minhash.near_duplicates,
        "keep_one": minhash.keep_one,
        "mix": mixing.mix_sources,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "clean": lambda d: toxicity.clean(d, labels),
        "classlm": classlm.lm_scores,
    }


NAMES = ["langid", "lines", "drop_lines", "leaks", "without_leaks", "substrings", "units", "drop_units", "near", "keep_one", "mix", "toxicity", "clean", "classlm"]
FILTERS = {"drop_lines", "drop_units", "without_leaks", "keep_one", "clean"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, name):
    docs = _docs(spark, ODD)
    got = _apply(spark)[name](docs)
    rows = got.collect()
    if name in FILTERS:
        assert got.columns == docs.columns
        assert any(r.text == LONG for r in rows)
    elif name not in ("leaks", "units"):
        assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    if name == "langid":
        assert by[1].lang_pred == by[2].lang_pred == by[9].lang_pred == "und"
    if name == "lines":
        assert by[7].removed == [0] and by[7].n_repeated == 1 and by[1].n_lines == 0 and by[2].n_lines == 1
    if name == "leaks":
        assert {(r.doc_id, r.item_id) for r in rows} == {(6, 1)}
    if name == "without_leaks":
        assert len(rows) == len(ODD) - 2
    if name == "units":
        assert [tuple(r) for r in rows] == [(7, 0, 49, 6, 0)]
    if name == "substrings":
        assert by[1].n_bytes == 0 and by[8].n_bytes == len(LONG)
    if name == "near":
        assert by[1].n_shingles == 0 and by[1].kept and by[5].component_id == 4 and by[None].component_id is None
    if name == "keep_one":
        assert len([r for r in rows if r.doc_id == 6]) == 2 and 5 not in by
    if name == "mix":
        assert by[1].taken == by[2].taken == 0 and all(r.taken <= 2 * r["size"] for r in rows)
    if name == "classlm":
        assert by[1].n_tokens == by[2].n_tokens == 1


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    docs = _docs(spark, ODD).limit(0)
    assert _apply(spark)[name](docs).collect() == []


def test_units_are_cut_at_their_places(spark):
    text = "One two three four five six. Ça va? Él y ella son de allí mismo, dice\nONE two  three four five six. End"
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, "So one. él y ella son de allí mismo, dice\nrest", None, None, 2)], DOCS)
    got = {(r.doc_id, text[r.first : r.end] if r.doc_id == 1 else r.first, r.kept_doc_id) for r in unitdedup.repeated_units(docs).collect()}
    assert got == {(1, "ONE two  three four five six.", 1)}
    assert {r.doc_id: r.text for r in unitdedup.drop_units(docs).collect()}[1] == text.replace("ONE two  three four five six.", "")


def test_passages_go_wherever_they_begin(spark):
    rng = np.random.default_rng(3)

    def prose(n, stops):
        words = [f"w{x}" for x in rng.integers(0, 5000, n)]
        return " ".join(w + "." if stops and i % 17 == 16 else w for i, w in enumerate(words))

    for stops, least in ((True, 0.6), (False, 0.6)):
        passages = [prose(80, stops) for _ in range(20)]
        rows = [(2 * i + k, f"{prose(9 + 7 * k, False)} {p} {prose(11, False)}.", None, None, None) for i, p in enumerate(passages) for k in (0, 1)]
        # a text in a script without blanks, and a short sentence that follows the same sentence
        rows += [(d, "\u6587\u5b57\u306e\u5217" * 9 + "\u3002" + str(d) + " own.", None, None, None) for d in (100, 101)]
        rows += [(d, f"Start {d}. This one sentence has some seven words. Yes it has. The end {d}.", None, None, None) for d in (200, 201)]
        rows += [(300, "Other words. Yes it has.", None, None, None)]
        kept = {r.doc_id: r.text for r in unitdedup.drop_units(spark.createDataFrame(rows, DOCS)).collect()}
        text = {r[0]: r[1] for r in rows}
        gone = [1 - len(kept[2 * i + 1]) / len(text[2 * i + 1]) for i in range(20)]
        own = [len(p) / len(text[2 * i + 1]) for i, p in enumerate(passages)]
        assert sum(gone) / sum(own) >= least and all(g <= o for g, o in zip(gone, own)) and all(gone)
        assert all(kept[2 * i] == text[2 * i] for i in range(20))
        assert kept[100] == text[100] and kept[101] == "101 own."
        assert kept[200] == text[200] and kept[201].split() == ["Start", "201.", "The", "end", "201."] and kept[300] == text[300]


def test_one_document_lines(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p\nx\nx\na b c d e f g h i j k l m n o p\na b c d e f g h i j k l m n o q\nz y", "en", "a", 1)], DOCS)
    (row,) = linededup.line_report(docs).collect()
    # a short line that repeats an earlier one goes like any other
    assert (row.n_lines, row.n_repeated, row.n_near, row.removed) == (6, 2, 1, [2, 3, 4])
    (row,) = linededup.drop_lines(docs).collect()
    assert row.text == "a b c d e f g h i j k l m n o p\nx\nz y" and row.n_chars == len(row.text)


def test_every_blank_parts_words_of_a_line(spark):
    words = "Ein Satz über die Grenzen DER Stadt hinaus".split()
    blanks = [" ", "  ", "\t", "\v", "\f", "\r", " \t ", "\r \f"]
    rows = [(k, f"{b}{b.join(words)}{b}") for k, b in enumerate(blanks)] + [(90, "\u00a0".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = linededup.each_line(linededup.lines_of(docs), lambda w: w, 1)
    got = {r.doc_id: r.made for r in plan.collect()}
    assert len({tuple(got[k]) for k in range(len(blanks))}) == 1 and len(got[0]) == len(words) and len(got[90]) == 1
    removed = {r.doc_id: r.removed for r in linededup.line_report(docs).collect()}
    assert removed == {0: [], 90: []} | {k: [0] for k in range(1, len(blanks))}


def test_short_lines_of_the_pipeline(spark):
    text = "Les.\nALL rights  reserved\n漢字漢字漢字\n\nrights all reserved"
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, "les.\nmore here\nall rights reserved\n漢字漢字漢字\n\n漢字", "en", "a", 1), (3, "LES.", "en", "a", 1)], DOCS)
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1: text, 2: "more here\n\n漢字"}


def test_small_sources_of_the_pipeline_meet_their_targets(spark):
    sizes = {"a": [5_000_000] * 1000, "b": [100] * 100, "c": [20] * 100, "d": [5] * 100, "e": [1] * 100, "f": [200] * 100, "g": [2000]}
    rows = [(1000 * k + i, source, "s" + source, n) for k, (source, mine) in enumerate(sizes.items()) for i, n in enumerate(mine)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, key string, size long").withColumn("mark", F.md5(F.col("doc_id").cast("string")))
    got = mixing.mix_sizes(sized, (5, 2, 1), 1.5, 2, mixing.SEED).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == len(sizes)
    assert all(r.taken == pytest.approx(r.target, rel=0.03) for r in got), got
