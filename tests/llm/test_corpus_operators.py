import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.llm import ann, lang_id, media, minhash, mixing, pii, quality, sp_codec, token_counts
from wayfold.llm.components import components

SF = "/root/testdata/sf0.01"


# -- mixing


def brute_targets(sizes):
    """The excess above the cap goes to the others by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in capped and goal[s] > 3 * sizes[s]}
        if not more:
            return goal
        capped |= more


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 2, None: 50}, {"x": 10}, {None: 3, "é": 1000, "z": 1, "Z": 40}, {"a": 0, "b": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "s string, n long").select(mixing._source_key(F.col("s")).alias("_src"), F.col("n").alias("_s"))
    got = {r["_src"]: r["_target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx({("n" if s is None else "s" + s): v for s, v in brute_targets(sizes).items()})


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, None).otherwise(F.col("source")))
    rows = mixing.plan(mixing.sized(docs)).select("_id", "_src", "_size", "_s", "_target", "_copies", "_shards").toPandas()
    largest = rows["_size"].max()
    for _, g in rows.groupby("_src"):
        assert abs((g["_size"] * g["_copies"]).sum() - g["_target"].iloc[0]) <= largest
        assert (g["_copies"] <= 3).all() and (g["_copies"] == g["_shards"].map(len)).all()
    out = mixing.mix(docs)
    assert out.count() == rows["_copies"].sum() and out.columns == [*docs.columns, "_shard"]
    again = mixing.plan(mixing.sized(docs.repartition(5))).select("_id", "_copies").toPandas()
    assert dict(zip(again["_id"], again["_copies"])) == dict(zip(rows["_id"], rows["_copies"]))


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 7), ("c", 1)], "_src string, _q long")
    leaves = mixing.splitting_tree(quotas, 8).collect()
    per = defaultdict(int)
    for r in leaves:
        per[r["_shard"]] += r["_q"]
    assert sorted(per.values()) == [13, 13, 13, 13, 14, 14, 14, 14]
    assert {s: sum(r["_q"] for r in leaves if r["_src"] == s) for s in "abc"} == {"a": 100, "b": 7, "c": 1}


def test_mix_odd_rows(odd, odd_rows, none):
    rows = mixing.plan(mixing.sized(odd)).collect()
    assert len(rows) == len(odd_rows) and all(r["_size"] * r["_copies"] <= 3 * r["_size"] for r in rows)
    assert mixing.mix(odd).where("pos = 3 and _row = 2").count() == sum(r["_copies"] for r in rows)
    assert mixing.plan(mixing.sized(none)).collect() == [] and mixing.mix(none).collect() == []


def brute_mixing(rows):
    """Of (doc_id, text, source): sizes, sizes of sources and targets, by plain loops."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    goal = brute_targets(total)
    return [(i, n, total[s], goal[s]) for n, (i, _, s) in zip(size, rows)]


def test_mixing_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = mixing.op3_mixing(spark, SF).collect()
    want = {i: x for i, *x in brute_mixing(rows)}
    taken = defaultdict(int)
    for r in got:
        n, s, goal = want[r.doc_id]
        assert (r["size"], r.source_size) == (n, s) and r.target == pytest.approx(goal) and r.taken in (0, n, 2 * n, 3 * n)
        taken[s, goal] += r.taken
    longest = max(n for n, _, _ in want.values())
    assert len(got) == len(rows) and all(abs(n - goal) <= longest for (_, goal), n in taken.items())
    assert {(r.doc_id, r.taken) for r in mixing.op3_mixing(spark, SF).collect()} == {(r.doc_id, r.taken) for r in got}


def test_mixing_rows_without_an_id(spark):
    """A third of all rows without an id, in one source: its taken words come near its target all the same."""
    rows = [(None if i % 3 == 0 else i, " ".join(["w"] * (5 + i % 7)) + f" {i}", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    got = mixing.plan(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))).toPandas()
    for _, g in got.groupby("_src"):
        assert abs((g["_size"] * g["_copies"]).sum() - g["_target"].iloc[0]) <= 12


# -- near duplicates


def brute_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            for a in sets[i]:
                for b in sets[j]:
                    if a and b and 100 * len(a & b) >= percent * len(a | b):
                        x, y = find(i), find(j)
                        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def families(seed=3):
    """Near copies of several texts with few to many edits, texts that share a passage, exact copies, and loners."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    out = []
    for size, length in ((70, 150), (40, 60), (6, 400)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(length), rng.choice([0, 1, 2, 3, 4, 5, 8, 20])):
                copy[at] = rng.choice([word(), copy[at].upper(), "the"])
            out.append(" ".join(copy))
    passage = " ".join(word() for _ in range(45))
    out += [f"{' '.join(word() for _ in range(12))} {passage} {' '.join(word() for _ in range(8))}" for _ in range(60)]
    out += [out[3]] * 9 + [" ".join(word() for _ in range(80)) for _ in range(20)] + ["one two", "one two", "one", "", None]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rows = families()
    want, sets = brute_groups(rows, width, percent)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width, percent).collect()
    assert {r["_id"]: r["_component"] for r in got} == want
    assert all(r["_n"] == len(sets[r["_id"]][0]) and r["_kept"] == (r["_id"] == r["_component"]) for r in got)


def test_core_pairs_lose_nothing(spark):
    """Within a group, every pair that is similar enough is linked or a candidate, or connected to begin with."""
    rows = [(i, t) for i, t in families(9) if t and len(t) > 10]
    texts = spark.createDataFrame(rows, "_rep long, _text string")
    grouped = spark.createDataFrame([(0, i, i) for i, _ in rows], "_hub long, _rep long, _comp long")
    links, candidates = minhash.core_pairs(grouped, texts, 3, 85)
    groups = components(links.union(candidates)).collect()
    comp = {r.node: r.comp for r in groups}
    want, _ = brute_groups(rows, 3, 85)
    for i, root in want.items():
        if i != root:
            assert comp[i] == comp[root]
    near = {(r.a, r.b) for r in links.collect()}
    assert all(want[a] == want[b] for a, b in near)
    assert len(near) + candidates.count() < len(rows) ** 2 / 8


def test_common_passages_make_no_quadratic_join(spark):
    """Nearly half of a group share a passage but are not similar enough: pairs stay far under the square, and grow with the group."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, passage = [word() for _ in range(120)], [word() for _ in range(9)]
    made = []
    for n in (400, 1600):
        rows = []
        for i in range(n):
            own = list(base)
            for at in rng.sample(range(120), 7):
                own[at] = word()
            rows.append((i, " ".join(own[:60] + (passage if i % 20 < 9 else [word() for _ in range(9)]) + own[60:])))
        texts = spark.createDataFrame(rows, "_rep long, _text string")
        grouped = spark.createDataFrame([(0, i, i) for i, _ in rows], "_hub long, _rep long, _comp long")
        links, pairs = minhash.core_pairs(grouped, texts, 3, 85, most=256)
        made.append(links.count() + pairs.count())
    assert made[1] <= 8 * max(made[0], 400) and made[1] < 1600**2 / 100


def test_near_duplicates_of_string_ids_and_two_texts_of_one_id(spark):
    base = [" ".join(f"w{k}{i}" for i in range(40)) for k in range(3)]
    rows = [("b", base[0]), ("a", base[0] + " end"), ("c", base[1]), ("c", base[2]), ("d", base[2] + " end"), ("c", base[1])]
    got = {(r["_id"], r["_n"], r["_component"], r["_kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), 3, 85).collect()}
    assert got == {("b", 38, "a", False), ("a", 39, "a", True), ("c", 38, "c", True), ("d", 39, "c", False)}


def test_near_duplicates_odd_rows(odd, odd_rows, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    assert all(r["_kept"] and r["_component"] is None for r in got if r["_id"] is None)
    by = {r["_id"]: r for r in got}
    assert by[8]["_component"] == 7 and not by[8]["_kept"] and by[0]["_component"] == 0 and by[14]["_component"] == 13
    assert minhash.near_duplicates(none).collect() == []


def test_components_of_a_path(spark):
    ids = list(range(0, 200))
    random.Random(2).shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in ids} | {500: 500, 501: 500}


# -- language, quality


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang_id.op6_lang_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_odd_rows(odd, odd_rows, none):
    network = lang_id.train(["the cat sat on the mat"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4)
    got = lang_id.identify(odd, network).collect()
    assert len(got) == len(odd_rows)
    assert {(r["_lang"], r["_score"]) for r in got if r.text is None or not any(map(str.isalpha, r.text))} == {("und", 0.0)}
    assert {r["_lang"] for r in lang_id.identify(odd, None).collect()} == {"und"}
    assert lang_id.learn(none) is None and lang_id.identify(none, network).collect() == []
    assert lang_id.learn(odd) is not None


def slow_language(net, text):
    """lang_pred and score of one text, window by window, position by position."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    raw = text.encode().lower()
    total = np.zeros(len(net.labels))
    for at in range(0, len(raw), lang_id.WINDOW):
        part = raw[at : at + lang_id.WINDOW]
        x = np.frombuffer(part.ljust(lang_id.WINDOW, b"\0"), np.uint8)
        pooled = [np.maximum(np.max([sum(w[k, x[p + k]] for k in range(len(w))) for p in range(lang_id.WINDOW - len(w) + 1)], axis=0) + b, 0) for w, b in zip(net.filters, net.biases)]
        z = np.exp(np.concatenate(pooled) @ net.dense + net.bias)
        total += len(part) * z / z.sum()
    total /= len(raw)
    return net.labels[int(total.argmax())], float(total.max())


def test_language_query_against_brute_force(spark):
    """The query's rows for a small table from the learned network by its definition."""
    import zlib

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    net, texts = lang_id.learn(docs), {r.doc_id: r.text for r in docs.collect()}
    got = lang_id.op6_lang_id(spark, folder).collect()
    assert len(got) == len(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    for r in got:
        if len(texts[r.doc_id] or "") < 3000:
            lang, score = slow_language(net, texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_rare_languages_are_learned(spark):
    """One label in a thousand rows, and labels in the far part of long texts only."""
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word("abcdefg") for _ in range(50)), "common") for i in range(4000)] + [(9000 + i, " ".join(word("qrstuvw") for _ in range(600)), "rare") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = lang_id.learn(docs, rows=100, windows=400)
    assert net.labels == ["common", "rare"]
    got = lang_id.identify(docs.where("doc_id >= 9000 or doc_id % 40 = 0"), net).collect()
    assert all(r["_lang"] == r.lang for r in got)


def test_network_matches_its_definition():
    rng = np.random.default_rng(0)
    net = lang_id.train(["abc def ghi"] * 3 + ["xyz uvw rst"] * 3, ["p"] * 3 + ["q"] * 3, epochs=1)
    x = rng.integers(0, 256, (5, lang_id.WINDOW)).astype(np.uint8)
    pooled = []
    for w, b in zip(net.filters, net.biases):
        z = np.stack([sum(w[k][x[:, p + k]] for k in range(len(w))) for p in range(lang_id.WINDOW - len(w) + 1)], axis=1)
        pooled.append(np.maximum(z.max(axis=1) + b, 0))
    h = np.concatenate(pooled, axis=1) @ net.dense + net.bias
    want = np.exp(h) / np.exp(h).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(x), want, atol=1e-4)


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.7, 0.6, 0.85])
    votes = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, found, share = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03 and np.abs(found.mean(axis=1) - right).max() < 0.04
    assert ((good[(patterns == 1).all(axis=1)] > 0.9)).all()


def test_quality_ranks_labels(spark):
    got = quality.op8_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()

    def auc(score):
        order = score.rank()
        n = (got.quality == 1).sum()
        return (order[got.quality == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n))

    assert auc(got.posterior) > 0.95 and auc(got.score) > 0.9
    assert got[got.quality == 1].kept.mean() > 0.98


def test_quality_odd_rows(odd, odd_rows, none):
    got = quality.quality(odd).collect()
    assert len(got) == len(odd_rows) and all(r["_score"] == 0.0 and not r["_kept"] for r in got if r["_id"] in (0, 1, 2))
    assert quality.quality(none).collect() == []


def test_quality_sample_is_not_taken_by_null_ids(spark):
    rows = [(None if i % 4 == 0 else i, f"text number {i} " * 20) for i in range(4000)]
    docs = spark.createDataFrame(rows, "_id long, _text string").repartition(5)
    a, b = (quality.sampled_features(docs, 500, 4000) for _ in range(2))
    assert len(a) == 500 and all((x[1] == y[1]).all() for x, y in zip(a, b))
    from wayfold.llm.common import bounded_sample

    picked = bounded_sample(docs, 500, "_id", "_text")
    assert len(picked) == 500 and 0.15 < sum(r["_id"] is None for r in picked) / 500 < 0.35


def test_quality_query_against_brute_force(spark):
    """Every row's posterior is its pattern's, from EM on the votes of a plain implementation; the scorer is logistic regression on whole texts."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    votes = {i: brute_votes(t or "") for i, t in docs.items()}
    patterns = sorted(set(votes.values()))
    counts = np.array([sum(v == p for v in votes.values()) for p in patterns], float)
    good, _, _ = quality.expectation_maximisation(np.array([[int(x) for x in p.split(",")] for p in patterns]), counts)
    want = dict(zip(patterns, good))
    rows = [(f, want[votes[i]]) for i, t in docs.items() if (f := quality.counted_features(t))]
    got = quality.op8_quality(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.posterior == pytest.approx(want[votes[r.doc_id]], abs=1e-9) and r.kept == (r.score >= 0.5)
    by = {r.doc_id: r.score for r in got}
    weights, bias = quality.fit_scorer([f for f, _ in rows], np.array([p for _, p in rows]))
    again = {i: float(1 / (1 + np.exp(-(weights[f[0]] @ f[1] + bias)))) for i, t in docs.items() if (f := quality.counted_features(t))}
    assert np.corrcoef([by[i] for i in again], list(again.values()))[0, 1] > 0.98 and all(by[i] == 0 for i in docs if i not in again)


def test_clashing_columns_stay(odd, odd_rows, none):
    network = lang_id.train(["the cat sat on the mat"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4)
    names = ["_row", "_new", "_found", "_lang", "_score", "_h", "_size", "_block", "_part", "_shards", "_spans"]
    wide = odd.withColumns({n: F.lit(f"own {n}") for n in names})
    for out, new in ((lang_id.identify(wide, network), {"_lang", "_score"}), (mixing.mix(wide), {"_shard"}), (pii.pii_spans(wide), {"_spans"})):
        rows = out.collect()
        assert set(wide.columns) | new == set(out.columns) and all(r[n] == f"own {n}" for r in rows for n in names if n not in new)
    ids = wide.withColumnsRenamed({"doc_id": "a.b", "text": "t`x"})
    key = sorted(map(str, (r[0] for r in odd_rows)))
    outs = [minhash.near_duplicates(ids, id_col="a.b", text_col="t`x"), quality.quality(ids, "a.b", "t`x"), token_counts.token_counts(ids, id_col="a.b", text_col="t`x"), sp_codec.encode_decode(ids, id_col="a.b", text_col="t`x"), media.pages_of(ids, "a.b", "t`x")]
    for out in outs:
        assert sorted(str(r["_id"]) for r in out.collect()) == key


def brute_votes(t):
    """Labellers on words without white space and lines that aren't empty."""
    words, lines = re.findall(r"[^ \t\n\x0b\f\r]+", t), [x for x in t.split("\n") if x]
    n, k, distinct = max(1, len(words)), len(lines), len(set(lines))
    ended, known = len(re.findall(r"[.!?] *(?:\n|\Z)", t)), set(quality.FUNCTION_WORDS.split())
    size, symbols, digits = (len(t) - len(words)) / n, sum(c in quality.SYMBOLS for c in t) / n, sum(c in "0123456789" for c in t) / n
    function = sum(w.lower() in known for w in words) / n
    vote = lambda good, bad: 0 if bad else 1 if good else -1
    votes = [vote(len(words) >= 60, len(words) < 15), vote(symbols < 0.02, symbols > 0.15), vote(3 <= size <= 9, not 2 <= size <= 14), vote(k >= 3 and distinct == k, k >= 3 and distinct < 0.7 * k),
        vote(k > 0 and ended >= 0.7 * k, k > 0 and ended < 0.2 * k), vote(function >= 0.12, function < 0.03), vote(digits < 0.1, digits > 1)]
    return ",".join(map(str, votes))


def test_votes_on_blank_lines_tabs_and_double_spaces(spark):
    lines = [f"the story of house {w} is told in this long line." for w in ("one", "two", "three", "four", "five", "six")]
    texts = ["\n\n".join(lines), "\n".join(lines), "\n\n\n".join(lines[:2] * 3), "\t".join(" ".join(lines).split()), "  ".join(" ".join(lines[:2]).split()), "\n \n".join(lines), " \n\n", "", "\n" + lines[0] + "\n\n", "a\t1 2  #\n\r\nb"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality.vote_pattern(F.col("t")).alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: brute_votes(t) for i, t in enumerate(texts)}
    assert brute_votes(texts[0]).split(",")[3:5] == ["1", "1"]


# -- nearest neighbours


def recall(rows, got):
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and ids[i] not in set(mine.vec_id)
        assert np.allclose(mine.score, [x[np.flatnonzero(ids == v)[0]] @ x[i] for v in mine.vec_id])
        hits, total = hits + len(set(best) & set(mine.vec_id)), total + 20
    return hits / total


def test_ann_recall_of_the_forest_alone(spark):
    """Leaves small enough for two tiers of each tree and far more of them than are probed: nothing but the forest finds candidates."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    vectors = df.select(F.col("vec_id").alias("cid"), F.col("embedding")).toPandas()
    raw = spark.createDataFrame([(int(c), np.asarray(v, "<f8").tobytes()) for c, v in zip(vectors.cid, vectors.embedding)], "cid long, vec binary")
    index, subtrees = ann.grow(raw, 1.0, "<f8", leaf=16)
    sizes = index.groupBy("tree", "cell").count().toPandas()
    assert len(subtrees) >= 2 and sizes["count"].max() <= 24 and sizes.groupby("tree")["count"].sum().eq(len(rows)).all()
    assert len(sizes) > 4 * 130
    got = ann.nearest(df, lambda i: i % 20 == 0, leaf=16, probes=130).toPandas()
    assert recall(rows, got) >= 0.9


def test_probes_are_those_of_least_penalty():
    rng = np.random.default_rng(3)
    q, cells = rng.standard_normal(9), []
    for tree in range(3):
        cells.append((0.1 * tree, tree, 1, 3, rng.standard_normal(7) * 0.3))
    cells.append((0.05, 3, 9, 0, None))
    want = [(0.05, 3, 9)]
    for penalty, tree, cell, bits, splits in cells[:3]:
        m = ann.directions(tree, 0, 9)[:7] @ q - splits
        for leaf in range(8):
            node, p = 0, penalty
            for k in (2, 1, 0):
                right = leaf >> k & 1
                p += max(-m[node] if right else m[node], 0) ** 2
                node = 2 * node + 1 + right
            want.append((p, tree, cell * 8 + leaf))
    got = ann.probe(q, cells, 12, 0)
    assert [x[1:] for x in got] == [x[1:] for x in sorted(want)[:12]] and [x[0] for x in got] == pytest.approx([x[0] for x in sorted(want)[:12]])
    assert len(ann.probe(q, cells, 100, 0)) == 25


def test_further_leaves_hand_on_what_reaches_the_first_ones_bound(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 8))
    rows = pd.DataFrame({"cid": np.arange(1500), "vec": [v.tobytes() for v in x]})
    queries = pd.DataFrame({"query": [3, 4], "vec": [x[3].tobytes(), x[4].tobytes()], "least": [-np.inf, np.sort(x @ x[4])[-5] - 1e-9]})
    got = ann._score(21, "<f8")(rows, queries)
    assert got["query"].value_counts().to_dict() == {3: 21, 4: 5}

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    want = ann.nearest(df, lambda i: i % 20 == 0, leaf=16, probes=96).collect()
    handed, score = [], ann._score
    monkeypatch.setattr(ann, "FEW", 1)
    monkeypatch.setattr(ann, "_score", lambda *a: handed.append(a) or score(*a))
    monkeypatch.setattr(ann, "round", lambda _: 96, raising=False)  # as many leaves in all, eight of them first
    assert ann.nearest(df, lambda i: i % 20 == 0, leaf=16, probes=8, growth=1.0).collect() == want
    assert len(handed) == 2


def test_ann_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 2.0]), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [1.0]), (105, [float("inf"), 0.0]), (None, [1.0, 1.0]), (120, [None, 1.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cid string").repartition(3)
    got = ann.nearest(df, lambda i: i % 20 == 0).toPandas()
    assert set(got.query_id) == {0, 20, 40, 100}
    assert list(got[got.query_id == 20].sort_values("rank").vec_id) == [i for i in range(21) if i != 20]
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == list(range(20))
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).collect() == []


# -- media


def test_sequence_keeps_order_and_captions():
    page = '<p>Hi <b>you</b></p><script>x()</script><figure><img src="sha256:ab" alt="q"><figcaption>cap &amp; tion</figcaption></figure>tail<video src="sha256:cd"></video>'
    assert media.sequence(page) == [
        {"pos": 0, "kind": "text", "text": "Hi you", "digest": None, "caption": None}, {"pos": 1, "kind": "media", "text": None, "digest": "ab", "caption": "cap & tion"},
        {"pos": 2, "kind": "text", "text": "tail", "digest": None, "caption": None}, {"pos": 3, "kind": "media", "text": None, "digest": "cd", "caption": None},
    ]
    assert media.sequence(None) == [] == media.sequence("")


def items(page):
    return [(x["kind"], x["text"] if x["kind"] == "text" else x["digest"], x["caption"]) for x in media.sequence(page)]


def test_captions_and_broken_pages():
    img, cap = '<img src="sha256:{0}">'.format, "<figcaption>{0}</figcaption>".format
    t, m = lambda x: ("text", x, None), lambda d, c=None: ("media", d, c)
    cases = {
        f"<figure>{cap('c')}{img('a')}</figure>{img('b')}": [m("a", "c"), m("b")],  # caption first; none for what follows
        f"<figure>{img('a')}{img('b')}{cap('c')}</figure>": [m("a", "c"), m("b", "c")],
        f"<figure>{img('a')}</figure>tail{cap('stray')}{img('b')}": [m("a"), t("tail"), t("stray"), m("b")],
        f"<figure>{img('a')}<figcaption>open</figure><p>after</p>{img('b')}": [m("a", "open"), t("after"), m("b")],
        f"<figure>{img('a')}<figcaption>open<p>rest of the page</p>{img('b')}": [m("a"), t("open"), t("rest of the page"), m("b")],
        f"<figure>{cap('alone')}</figure><p>x</p>": [t("alone"), t("x")],
        f"<figure>{img('a')}<figure>{img('b')}{cap('c')}</figure>": [m("a"), m("b", "c")],
        f"a<template>hidden {img('z')}</template>b": [t("a"), t("b")],
        f"a<template>shown {img('z')} b": [t("a"), t("shown"), m("z"), t("b")],
        "a<style>p{}</style>b<script>if (a < b) x()</script>c": [t("abc")],
        f'<img src="x.png" alt="alt"><img>{cap("no figure")}': [m("x.png", "alt"), m(""), t("no figure")],
        "<p>one <b>bold</b> two<br>three": [t("one bold two"), t("three")],
    }
    for page, want in cases.items():
        assert items(page) == want, page
    assert all([x["pos"] for x in media.sequence(p)] == list(range(len(w))) for p, w in cases.items())


def test_pages_table(spark):
    """Real pages: all visible words come out once and in order."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style")

        def handle_data(self, data):
            self.out += [] if self.off else [data]

    for r in media.interleave(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        w = Words()
        w.feed(r.html or "")
        assert "".join("".join(x.text for x in r["_sequence"]).split()) == "".join("".join(w.out).split())


def brute_media(text):
    """What the contract says of one text, apart from the feature."""
    import hashlib
    import zlib

    raw = (text or "").encode()
    full = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
    stored = f"P5\n24 {len(full) // 24}\n255\n".encode() + full
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(raw), len(full), sha(full), zlib.crc32(full[-32:]) & 0xFFFFFFFF, len(stored), sha(stored)


def brute_feature(text):
    raw = (text or "").encode()
    full = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
    high = len(full) // 24
    hist = [sum(n for b, n in zip(*np.unique(list(full), return_counts=True)) if b // 32 == k) for k in range(8)]
    edges = [int(i * high / 8) for i in range(9)]
    grid = [[np.mean([full[y * 24 + x] for y in range(edges[i], edges[i + 1]) for x in range(3 * j, 3 * j + 3)]) for j in range(8)] for i in range(8)]
    bits = "".join("1" if v > np.mean(grid) else "0" for row in grid for v in row)
    return f"h={high};mean={sum(full) / len(full):.6f};hist={','.join(map(str, hist))};ahash={int(bits, 2):016x}"


def test_media_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = media.op10_media(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == brute_media(t)
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert r.caption == f"payload of {r.n_bytes} bytes" and r.position == (1 if (t or "").split("\n")[0].split() else 0) and r["items"] == len(lines) + 1
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        texts = [[sha(" ".join(x.split())) for x in part if x.split()] for part in ((t or "").split("\n")[:1], (t or "").split("\n")[1:])]
        figure = f"{r.position}\tmedia\t{r.payload_sha256} {r.media_sha256}\t{r.caption}"
        items = [*[f"0\ttext\t{sha(chr(10).join(x))}\t" for x in texts[:1] if x], figure, *[f"{r.position + 1}\ttext\t{sha(chr(10).join(x))}\t" for x in texts[1:] if x]]
        assert r.sequence_sha256 == sha("\n".join(items))
    assert all(r.feature == brute_feature(docs[r.doc_id]) for r in got[:40])


def test_folding_keeps_places_and_media(spark):
    html = '<img src="sha256:a"><img src="sha256:b"><p>x</p><p>y</p><img src="sha256:c"><p>z</p>'
    rows = media.interleave(spark.createDataFrame([(html,), ("<p>only</p><p>text</p>",), ("",), (None,), ('<img src="sha256:d">',)], "html string"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = [[(s.pos, s.kind, s.digest) for s in r[0]] for r in rows.select(media.folded(F.col("_sequence"))).collect()]
    assert got == [[(0, "media", "a"), (1, "media", "b"), (2, "text", sha(sha("x") + "\n" + sha("y"))), (4, "media", "c"), (5, "text", sha(sha("z")))], [(0, "text", sha(sha("only") + "\n" + sha("text")))], [], [], [(0, "media", "d")]]


def test_payloads_survive(spark, odd, odd_rows, none):
    pages = media.interleave(media.pages_of(odd), "_html").drop("_html")
    table = media.store(odd.select(media.payload_of(F.col("text")).alias("payload")))
    got = media.resolve(pages, media.described(table)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        texts = {t for i, t, *_ in odd_rows if i == r["_id"]}
        found = [s.media for s in r["_sequence"] if s.kind == "media"]
        assert len(found) == 1 and (r["_n_bytes"], found[0].payload_bytes, found[0].payload_sha256) in {brute_media(t)[:3] for t in texts}
    stored = {r.digest: bytes(r.stored) for r in table.collect()}
    assert stored and all(__import__("hashlib").sha256(media.decode(v).tobytes()).hexdigest() == k for k, v in stored.items())
    raw = media.payload("é" * 1000)
    assert media.decode(media.encode(raw)).tobytes() == raw
    with pytest.raises(ValueError):
        media.decode(media.encode(raw)[:-1])
    empty = none.select(media.payload_of(F.col("text")).alias("payload"))
    assert media.store(empty).collect() == [] and media.pages_of(none).collect() == [] and media.described(media.store(empty)).collect() == []


def test_sequences_are_resolved_in_place(spark):
    clash = "page int, html string, digest string, feature string, _key string, _media int, _found int, _row int, _pos int, caption string, `a.b` string"
    known = media.payload("a")
    import hashlib

    d = hashlib.sha256(known).hexdigest()
    html = f'<p>x</p><img src="sha256:{d}"><p>y</p><img src="sha256:zz" alt="q"><img src="sha256:{d}">'
    rows = [(i, h, "c", "c", "c", 1, 2, 3, 4, "c", "d") for i, h in enumerate([html, html, "<p>no media</p>", None, ""])]
    pages = media.interleave(spark.createDataFrame(rows, clash))
    table = media.described(media.store(spark.createDataFrame([(bytearray(known),), (None,)], "payload binary")))
    got = {r.page: r for r in media.resolve(pages, table).collect()}
    assert len(got) == 5 and all((r.digest, r["_row"], r["a.b"], r.caption) == ("c", 3, "d", "c") for r in got.values())
    for k in (0, 1):
        assert [(s.pos, s.kind, s.text or s.digest, s.media and s.media.payload_bytes) for s in got[k]["_sequence"]] == [(0, "text", "x", None), (1, "media", d, 576), (2, "text", "y", None), (3, "media", "zz", None), (4, "media", d, 576)]
    assert [s.text for s in got[2]["_sequence"]] == ["no media"] and got[3]["_sequence"] == [] == got[4]["_sequence"]
