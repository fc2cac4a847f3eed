"""Topic and attitude models against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import attitude, statistics, topics


def test_assignments_of_any_shape():
    rng = random.Random(1)
    for n, m in ((1, 1), (4, 4), (3, 6), (6, 3), (5, 5)) * 6:
        cost = [[rng.choice([0, 1, 2, rng.random()]) for _ in range(m)] for _ in range(n)]
        got = topics.best_assignment(cost)
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert len(pairs) == min(n, m) == len({j for _, j in pairs})
        if n <= m:
            least = min(sum(cost[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        else:
            least = min(sum(cost[r][j] for j, r in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert sum(cost[i][j] for i, j in pairs) == pytest.approx(least)
    assert len(set(topics.best_assignment(np.random.default_rng(1).random((40, 40)).tolist()))) == 40


def test_digamma():
    x = np.array([0.1, 0.5, 1.0, 2.5, 7.0, 100.0])
    step = 1e-5
    slope = [(math.lgamma(v + step) - math.lgamma(v - step)) / (2 * step) for v in x]
    assert topics.digamma(x) == pytest.approx(slope, abs=1e-6)


def test_batch_model_by_a_plain_pass(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["aa bb cc", "dd ee ff"][i % 2].split()) for _ in range(30)), 2020 + i % 3) for i in range(40)]
    df = spark.createDataFrame([*docs, (99, "", 2020)], "doc_id long, text string, year int")
    words, rows = topics.term_arrays(df, 1, 1.0)
    assert words == ["aa", "bb", "cc", "dd", "ee", "ff"] and rows.count() == 40
    model = topics.BatchLDA(2, len(words), seed=1)
    expected, total = model.expected(), np.zeros((2, 6))
    for r in rows.collect():
        total[:, r.ids] += topics.mixture(np.array(r.ids), np.array(r.counts, float), expected, model.prior)[1]
    assert model.step(rows) == pytest.approx(0.5 + total * expected, rel=1e-9)
    model.fit(rows, 15)
    top = [{words[w] for w in t} for t in topics.top_words(model.components, 3)]
    assert sorted(map(sorted, top)) == [["aa", "bb", "cc"], ["dd", "ee", "ff"]]
    mixed = model.mixtures(rows, "doc_id", "year")
    best = {r.doc_id: int(np.argmax(r.p)) for r in mixed.collect()}
    assert len({best[i] for i in range(0, 40, 2)}) == 1 != len(set(best.values()))
    yearly = topics.mixture_prevalence(mixed, "p", "year").collect()
    assert sum(r.dominant_documents for r in yearly) == 40 and sum(r.prevalence_pct for r in yearly if r.year == 2020) == pytest.approx(100)


def test_special_functions():
    x = np.array([0.02, 0.5, 1.0, 2.5, 7.0, 100.0, 1e5])
    assert topics.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-9)
    step = 1e-4 * x
    assert topics.trigamma(x) == pytest.approx((topics.digamma(x + step) - topics.digamma(x - step)) / (2 * step), rel=1e-5)


def plain_online(docs, slots, steps, vocabulary, k, seed, passes, n):
    """Hoffman's updates over whole matrices, one document and one word at a time."""
    lam, alpha, eta, done = np.random.default_rng(seed).gamma(100.0, 0.01, (vocabulary, k)).T, np.full(k, 1 / k), 1 / k, 0
    share = lambda g: topics.digamma(g) - topics.digamma(np.array(g.sum()))

    def gamma_of(doc, words):
        gamma, change = np.ones(k), 1.0
        while change > 1e-3:
            fresh = alpha + sum(c * (p := np.exp(share(gamma)) * words[:, w]) / p.sum() for w, c in doc.items())
            change, gamma = np.abs(fresh - gamma).mean(), fresh
        return gamma

    for _ in range(passes):
        for at in range(steps):
            done += 1
            own = [d for d, s in zip(docs, slots, strict=True) if s // topics.PARTS == at]
            if not own:
                continue
            words, total, shares = np.exp(topics.digamma(lam) - topics.digamma(lam.sum(1, keepdims=True))), np.zeros_like(lam), np.zeros(k)
            for doc in own:
                shares += share(gamma := gamma_of(doc, words))
                for w, c in doc.items():
                    total[:, w] += c * (p := np.exp(share(gamma)) * words[:, w]) / p.sum()
            rho = (1024 + done) ** -0.51
            lam = (1 - rho) * lam + rho * (eta + total * n / math.ceil(n / steps))
            slope, c, q = len(own) * (shares / len(own) - share(alpha)), len(own) * topics.trigamma(alpha.sum()), -len(own) * topics.trigamma(alpha)
            alpha = alpha - rho * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    words = np.exp(logs := topics.digamma(lam) - topics.digamma(lam.sum(1, keepdims=True)))
    lg, bound = math.lgamma, 0.0
    for doc in docs:
        e = share(gamma := gamma_of(doc, words))
        bound += sum(c * math.log(np.exp(e + logs[:, w]).sum()) for w, c in doc.items()) + ((alpha - gamma) * e).sum()
        bound += sum(lg(g) - lg(a) for g, a in zip(gamma, alpha, strict=True)) + lg(alpha.sum()) - lg(gamma.sum())
    bound += ((eta - lam) * logs).sum() + sum(lg(x) - lg(eta) for x in lam.flat) + sum(lg(vocabulary * eta) - lg(r) for r in lam.sum(1))
    return lam, alpha, -bound / sum(sum(d.values()) for d in docs)


def test_online_model_by_a_plain_one(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa bb cc dd", "ee ff gg", "aa hh"][i % 3].split()) for _ in range(rng.randint(1, 25))) for i in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (99, ""), (98, "rare")], "doc_id long, text string")
    words, rows = topics.vectorised(df, 2, 1.0)
    got = {r.doc_id: {words[i]: c for i, c in zip(r.ids, r.counts, strict=True)} for r in rows.collect()}
    assert got == {i: {w: t.split().count(w) for w in t.split()} for i, t in enumerate(texts)} | {98: {}}
    every = " ".join(texts).split()
    assert words == sorted(set(every), key=lambda w: (-every.count(w), w))

    batches = topics.Minibatches(rows, 8)
    known = [r for r in rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(batches.steps * topics.PARTS))).orderBy("doc_id").collect() if r.ids]
    docs = [dict(zip(r.ids, r.counts, strict=True)) for r in known]
    model = topics.OnlineLDA(3, len(words), 5).fit(batches, 3)
    lam, alpha, perplexity = plain_online(docs, [r.slot for r in known], batches.steps, len(words), 3, 5, 3, 61)
    assert batches.n == 61 and batches.steps == 8
    assert model.components == pytest.approx(lam, rel=1e-5) and model.prior == pytest.approx(alpha, rel=1e-5)
    assert model.log_perplexity(batches) == pytest.approx(perplexity, rel=1e-5)
    shown = topics.topic_words(words, model, 2).orderBy("topic", "rank").collect()
    assert [r.weight for r in shown] == pytest.approx(np.sort(lam / lam.sum(1, keepdims=True), axis=1)[:, :-3:-1].reshape(-1), rel=1e-5)
    assert sum(r.prevalence_pct for r in topics.topic_prevalence(model, rows).collect()) == pytest.approx(100 * 60 / 61)


def test_weights_are_found_together(monkeypatch):
    """As for each document alone, in not much more rounds than the slowest one takes."""
    rng, calls, digamma = np.random.default_rng(6), [], topics.digamma
    words = rng.gamma(0.3, 1, (200, 5)) + 1e-4
    ids = [rng.choice(200, rng.integers(1, 40), replace=False) for _ in range(600)] + [np.arange(200)]
    counts, prior = [rng.integers(1, 9, len(x)).astype(float) for x in ids], np.full(5, 0.2)
    monkeypatch.setattr(topics, "digamma", lambda x: calls.append(1) or digamma(x))
    alone, rounds = [], []
    for i, c in zip(ids, counts, strict=True):
        calls.clear()
        ((_, gamma, places, ratio),) = topics.weights_of([i], [c], words, prior)
        alone.append((gamma[0], places[0], ratio[0]))
        rounds.append(len(calls))
    calls.clear()
    seen = []
    for docs, gamma, places, ratio in topics.weights_of(ids, counts, words, prior):
        for row, d in enumerate(docs):
            m = len(ids[d])
            seen.append(d)
            assert gamma[row] == pytest.approx(alone[d][0], rel=1e-9) and (places[row, :m] == ids[d]).all()
            assert ratio[row, :m] == pytest.approx(alone[d][2], rel=1e-9) and not ratio[row, m:].any()
    assert sorted(seen) == list(range(601)) and len(calls) < 4 * max(rounds)


def test_a_step_reads_its_own_documents(spark):
    """What a step reads and sends doesn't grow with the documents of other steps."""
    df = spark.createDataFrame([(i, f"w{chr(97 + i % 26)} x{chr(97 + i // 26 % 26)}") for i in range(300)], "doc_id long, text string")
    _, rows = topics.vectorised(df, 1, 1.0)
    batches = topics.Minibatches(rows, 10)
    seen = [batches.run(lambda slot, words, ids, counts: (slot, len(ids)), [s for s in range(at * topics.PARTS, (at + 1) * topics.PARTS) if s in batches.words]) for at in range(batches.steps)]
    assert sum(n for step in seen for _, n in step) == 300 and max(sum(n for _, n in step) for step in seen) < 30
    assert {slot // topics.PARTS for slot, _ in seen[7]} == {7}


def test_a_grid_takes_a_task_for_a_model(spark, monkeypatch):
    """Its models are those fitted step by step; its jobs don't grow with the minibatches."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa bb cc dd", "ee ff gg", "aa hh"][i % 3].split()) for _ in range(rng.randint(1, 25))) for i in range(90)]
    df = spark.createDataFrame([*enumerate(texts), (99, "")], "doc_id long, text string")
    few = topics.Minibatches
    words, rows = topics.vectorised(df, 2, 1.0)
    stepped, alone = few(rows, 6), few(rows, 6, tasks=1)
    assert stepped.steps == alone.steps == 15 and {s // topics.PARTS for s in stepped.words} == set(alone.known) == set(alone.words)
    model = topics.OnlineLDA(3, len(words), 7).fit(stepped, 2)
    components, score = topics.fit_in_a_task(alone, 2, 3, len(words), 7)
    assert components == pytest.approx(model.components, rel=1e-5) and score == pytest.approx(model.log_perplexity(stepped), rel=1e-5)
    with pytest.raises(ValueError):
        topics.fit_in_a_task(stepped, 1, 3, len(words))

    monkeypatch.setattr(topics, "Minibatches", lambda rows, **more: few(rows, 6, **more))
    jobs, before = spark.sparkContext.statusTracker(), set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    got = {(r.k, r.seed): r for r in topics.fit_grid(df, (2, 3), (7, 8), 3, 7, passes=2, top=2, min_df=2, max_df=1.0).collect()}
    assert len(set(jobs.getJobIdsForGroup()) - before) < 3 * 2 * 15 / 3
    assert sorted(got) == [(2, 7), (3, 7), (3, 8)] and got[3, 7].mean_cosine == pytest.approx(1)
    assert got[3, 7].log_perplexity == pytest.approx(score, rel=1e-9)


def test_minibatches_pass_in_order(spark):
    df = spark.createDataFrame([(i, f"w{chr(97 + i % 26)} x{chr(97 + i // 26 % 26)}") for i in range(60)], "doc_id long, text string")
    _, rows = topics.vectorised(df, 1, 1.0)
    batches = topics.Minibatches(rows, 4, tasks=1)
    look = lambda found: [(slot, len(ids)) for slot, _, ids, _ in found]
    plain = batches.through(look, 3)
    assert [slot for slot, _ in plain] == 3 * batches.known and sum(n for _, n in plain) == 180
    early = batches.through(lambda found: [sum(map(len, found.gi_frame.f_locals["waiting"].values())) for _ in found], 3)
    assert max(early) == 0
    held = batches.parts.collect()
    batches.parts = spark.sparkContext.parallelize([held[3], *held[:3], *reversed(held[4:])], 3)
    assert batches.through(look, 3) == plain


def test_topics_are_compared():
    rng = np.random.default_rng(3)
    a = rng.random((4, 30))
    b = a[[2, 0, 3, 1]]
    assert [(i, j) for i, j, *_ in topics.matched_topics(a, b)] == [(1, 2), (2, 4), (3, 1), (4, 3)]
    assert all(c == pytest.approx(1) and x == 1 for _, _, c, x in topics.matched_topics(a, b))
    near = topics.nearest_topics(np.vstack([a, a[:1]]), b[:2])
    assert near[0][1:4] == (2, pytest.approx(1), 10) and near[0][5] >= 2 and near[4][:2] == (5, 2)
    assert topics.diversity(np.eye(3), 1) == 1


def test_information_of_pairs(spark):
    docs = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["x", "y"]), (3, ["x", "w"]), (4, ["x"])], "doc_id long, tokens array<string>")
    lists = spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (1, 1, "z"), (1, 2, "w"), (2, 1, "y"), (2, 2, "z"), (3, 1, "x"), (3, 2, "none"), (4, 1, "none"), (4, 2, "x"), (5, 1, "x")], "topic int, rank int, word string")
    got = {r.topic: r.npmi for r in topics.npmi(lists, docs).collect()}
    assert got[0] == pytest.approx(0) and got[1] == -1 and got[2] == pytest.approx(math.log(0.25 / (0.5 * 0.25)) / -math.log(0.25))
    assert got[3] is None and got[4] == -1 and got[5] is None
    every = spark.createDataFrame([(i, ["x", "y"]) for i in range(3)], "doc_id long, tokens array<string>")
    assert {r.topic: r.npmi for r in topics.npmi(lists.where("topic = 0"), every).collect()} == {0: 1}


def test_yearly_correlation(spark):
    rows = lambda xs: spark.createDataFrame([(2020 + i, 0, float(x)) for i, x in enumerate(xs)], "year int, topic int, prevalence_pct double")
    rho = lambda a, b: topics.yearly_correlation(rows(a), rows(b), [(1, 1)]).first().rho
    assert rho([1, 2, 3, 4], [2, 3, 9, 5]) == pytest.approx(0.8) and rho([1, 2], [1, 2]) is None and rho([1, 1, 1], [1, 2, 3]) is None
    assert rho([1, 1, 2], [3, 3, 4]) == pytest.approx(1)


def test_reconstruction(spark):
    kind = "topic int, rank int, word string, weight_pct double, prevalence_pct double"
    saved = [(0, 1, "a", 5.0, 50.0), (0, 2, "b", 4.0, 50.0), (1, 1, "c", 3.0, 50.0), (0, 11, "late", 1.0, 50.0)]
    near = [(0, 1, "a", 5.00005, 50.005), (0, 2, "x", 4.0, 50.0), (1, 1, "c", 3.0001, 50.0), (0, 11, "other", 1.0, 50.0)]
    got = topics.reconstruction_errors(spark.createDataFrame(saved, kind), spark.createDataFrame(near, kind)).collect()
    assert {(r.topic, r.rank, r.wrong) for r in got} == {(0, 2, "word"), (1, 1, "weight")}
    assert topics.reconstruction_errors(spark.createDataFrame(saved, kind), spark.createDataFrame(saved, kind)).count() == 0


def gradient(x, y, c, w, b):
    """Of the penalised loss with classes weighted evenly, at weights (features x classes)."""
    k, n = len(b), len(y)
    own = np.array([n / (k * (y == t).sum()) for t in y])
    z = x @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    e = c * own[:, None] * (p - np.eye(k)[y])
    return x.T @ e + w, e.sum(0)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_regression_is_at_its_optimum(classes):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 12))
    y = (x[:, 0] > 0).astype(int) + (classes == 3) * (x[:, 1] > 0.8)
    model = attitude.balanced_logistic(x @ x.T, y, 1.0)
    dw, db = gradient(x, y, 1.0, x.T @ model.alpha, model.bias)
    assert np.abs(dw).max() < 1e-6 and np.abs(db).max() < 1e-6
    assert (model.probabilities(x @ x.T).argmax(1) == y).mean() > 0.8


def test_grams(spark):
    text = "Ab  c"
    grams = [g for w in (" ab ", " c ") for n in (2, 3, 4) if n <= len(w) for g in (w[i : i + n] for i in range(len(w) - n + 1))]
    assert spark.createDataFrame([(text,)], "t string").select(attitude.char_grams("t").alias("g")).first().g == grams
    assert spark.createDataFrame([(None,), ("",)], "t string").select(attitude.char_grams("t").alias("g")).collect()[0].g == []


def test_supervised_scores_and_leave_one_out(spark):
    rng = random.Random(5)
    words = {1: ["good", "fine", "glad"], -1: ["bad", "sad", "poor"], 0: ["plain", "so", "even"]}
    rows = [(i, " ".join(rng.choice(words[(i % 3) - 1]) for _ in range(6)), (i % 3) - 1) for i in range(60)] + [(100, None, None), (101, "zzz", None)]
    docs = spark.createDataFrame(rows, "id long, text string, y int")
    got = {r.id: r for r in attitude.gram_logistic_scores(docs, docs, "id", "text", "y").collect()}
    assert all(np.argmax(got[i].probabilities) == i % 3 for i in range(60)) and all(sum(r.probabilities) == pytest.approx(1) for r in got.values())
    assert got[2].polarity > 0.2 and got[0].polarity < -0.2 and got[100].probabilities == got[101].probabilities
    loo = attitude.leave_one_out(docs, docs.where("id < 24"), "id", "text", "y").collect()
    assert len(loo) == 24 and sum(r.label == r.predicted for r in loo) >= 22
    one = attitude.leave_one_out(docs, docs.where("id IN (0, 3, 1)"), "id", "text", "y").collect()
    assert {r.id: r.predicted for r in one}[1] == -1


def test_specifications(spark):
    pos, neg = ["p1", "p2", "p3", "p4", "p5"], ["n1", "n2", "n3", "n4", "n5"]
    specs = attitude.specifications(pos, neg)
    assert len(specs) == 30 == len({s.name for s in specs}) and specs[0].name == "baseline"
    rng = np.random.default_rng(6)
    vectors = {w: v / np.linalg.norm(v) for w in [*pos, *neg, "a", "b", "rare"] for v in [rng.normal(size=5)]}
    texts = {1: ["a"] * 7 + ["b"] * 4 + ["p1"], 2: ["b", "rare"], 3: ["unknown"], 4: ["a", "b"] * 3}
    tokens = spark.createDataFrame([(i, w) for i, t in texts.items() for w in t], "doc_id long, word string")
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vectors.items()], "word string, vector array<double>")
    got = {r.doc_id: r.asDict() for r in attitude.axis_scores(tokens, table, pos, neg, specs).collect()}
    count = {w: sum(t.count(w) for t in texts.values()) for w in vectors}
    for s in specs:
        direction, mean, sd = attitude.axis(vectors, [w for w in pos if w != s.removed_positive], [w for w in neg if w != s.removed_negative])
        for i, t in texts.items():
            xs = sorted((vectors[w] @ direction - mean) / sd for w in t if w in vectors and count[w] >= s.min_frequency)
            cut = max(1, len(xs) // 10) if len(xs) >= 10 else 0
            want = 0.0 if not xs else np.mean(xs) if s.aggregation == "mean" else np.median(xs) if s.aggregation == "median" else np.mean(xs[cut : len(xs) - cut])
            assert got[i][s.name] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("n", [1, 9, 10, 25])
def test_trimmed_means(spark, n):
    rng = random.Random(n)
    xs = sorted(rng.choice([1.0, 2.0, rng.random() * 9]) for _ in range(n))
    cut = max(1, n // 10) if n >= 10 else 0
    row = statistics.trimmed_mean(spark.createDataFrame([("g", x) for x in xs] + [("g", None)], "g string, x double"), ["g"], "x").first()
    assert row.trimmed_mean == pytest.approx(np.mean(xs[cut : n - cut])) and row.n_kept == n - 2 * cut


def test_intervals_and_verdicts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "g string, x double")
    got = {r.g: (r.n, r.mean, r.ci) for r in statistics.mean_interval(df, ["g"], "x").collect()}
    assert got["a"] == (2, 2.0, pytest.approx(1.96)) and got["b"] == (1, 5.0, None) and got["c"] == (0, None, None)
    assert {r.g: r.ci for r in statistics.mean_interval(df, ["g"], "x", 0.0).collect()}["b"] == 0
    v = statistics.verdict(F.col("x"), [(0.5, "PARTIAL"), (0.75, "PASS")])
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([0.75, 0.5, 0.1, None])], "i int, x double").orderBy("i").select(v.alias("v")).collect()
    assert [r.v for r in rows] == ["PASS", "PARTIAL", "FAIL", "FAIL"]


@pytest.mark.parametrize("z", [-9.0, -3.5, -1.0, 0.0, 0.3, 2.999, 3.001, 8.0])
def test_normal_distribution(spark, z):
    got = spark.createDataFrame([(z,)], "z double").select(statistics.normal_cdf(F.col("z")).alias("p")).first().p
    assert got == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-12)


def test_kappa_without_spread(spark):
    df = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    row = statistics.agreement(df, "a", "b", [0, 1]).first()
    assert (row.n, row.accuracy, row.kappa, row.macro_f1) == (3, 1.0, None, 0.5)


def test_text_network(spark):
    from loomtext.operators import neural

    rng = random.Random(8)
    words = [["good", "fine", "glad"], ["bad", "sad", "poor"], ["plain", "so", "even"]]
    rows = [(i, " ".join(rng.choice(words[i % 3]) for _ in range(8)), i % 3 if i < 150 else None, i % 5 == 0) for i in range(180)] + [(900, None, None, False), (901, "", None, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, held boolean")
    net, best, scores = neural.train(df, "text", "y", "held", 3)
    assert 1 <= best <= 5 == len(scores) and scores[best - 1] == max(scores) > 0.9
    got = {r.doc_id: r.p for r in neural.infer(df, "text", net.probabilities, "p", batch=7).collect()}
    assert all(np.argmax(got[i]) == i % 3 for i in range(180)) and got[900] == got[901]
    assert got[3] == pytest.approx(net.probabilities([rows[3][1]])[0]) and sum(got[3]) == pytest.approx(1)
    vectors = neural.infer(df.limit(3), "text", net.embed).collect()
    assert all(np.linalg.norm(r.vector) == pytest.approx(1) for r in vectors)
    small = neural.TextNet(2, size=16, width=3)
    small.out = np.random.default_rng(1).normal(size=(3, 2))
    features, y = [np.array([1, 2, 2]), np.array([5])], np.array([0, 1])
    at, table, out, bias = small.gradients(features, y)

    def loss():
        code = np.stack([small.table[f].mean(0) for f in features])
        z = code @ small.out + small.bias
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[[0, 1], y]))

    for array, spot, want in ((small.table, (2, 1), table[list(at).index(2), 1]), (small.out, (0, 1), out[0, 1]), (small.bias, (1,), bias[1])):
        old = array[spot]
        array[spot] = old + 1e-6
        up = loss()
        array[spot] = old - 1e-6
        assert want == pytest.approx((up - loss()) / 2e-6, abs=1e-6)
        array[spot] = old


@pytest.mark.parametrize("size", [100_000, 7])
def test_places_in_strata(spark, size):
    import hashlib

    from loomtext.operators import sampling

    rows = [(i, None if i % 11 == 0 else "big" if i % 4 else "small") for i in range(300)]
    got = {r.id: (r._place, r._size) for r in sampling.placed(spark.createDataFrame(rows, "id long, g string"), "id", "g", rows_per_range=size).collect()}
    for g in (None, "big", "small"):
        own = sorted((i for i, x in rows if x == g), key=lambda i: hashlib.md5(f"42{i}".encode()).hexdigest())
        assert [got[i] for i in own] == [(n, len(own)) for n in range(1, len(own) + 1)]
    parts = sampling.stratified_split(spark.createDataFrame(rows, "id long, g string"), "id", "g", rows_per_range=size).groupBy("g", "part").count().collect()
    assert {(r.g, r["count"]) for r in parts if r.part == "validation"} == {(g, int(sum(x == g for _, x in rows) * 0.2 + 0.5)) for g in (None, "big", "small")}


def test_specification_summary(spark):
    specs = attitude.specifications(["p1"], ["n1"], frequencies=(3,), aggregations=("mean", "median"))
    names = [s.name for s in specs]
    assert names == ["baseline", "drop_p1_n1", "median"]
    rng = random.Random(9)
    rows = [(i, "en" if i % 2 else "fr", 2020 + i % 3, round(rng.gauss(0.2, 1), 1), rng.gauss(0, 1), 5.0) for i in range(60)]
    frame = spark.createDataFrame(rows, ["doc_id", "source", "year", *names])
    got = {r.spec: r for r in attitude.specification_summary(frame, specs, "source", "year", "en", "fr").collect()}

    def rho(a, b):
        rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
        return float(np.corrcoef(rank(a), rank(b))[0, 1])

    base, drop = [r[3] for r in rows], [r[4] for r in rows]
    assert got["drop_p1_n1"].spearman == pytest.approx(rho(base, drop)) and got["baseline"].spearman == pytest.approx(1)
    assert got["median"].spearman is None and got["median"].profile_spearman is None
    mean = lambda k, s: float(np.mean([r[k] for r in rows if r[1] == s]))
    assert got["drop_p1_n1"].mean_absolute_change == pytest.approx(np.mean(np.abs(np.array(base) - drop)))
    assert got["drop_p1_n1"].gap == pytest.approx(mean(4, "en") - mean(4, "fr")) and got["median"].gap == 0
    cells = sorted({(r[1], r[2]) for r in rows})
    profile = [[float(np.mean([r[k] for r in rows if (r[1], r[2]) == c])) for c in cells] for k in (3, 4)]
    assert got["drop_p1_n1"].profile_spearman == pytest.approx(rho(*profile))
    assert got["drop_p1_n1"].sign_same == (mean(3, "en") * mean(4, "en") > 0)
