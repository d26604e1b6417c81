import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from mentionary.llm import ctw, pii, quality, toxicity
from pyspark.sql import functions as F


def test_additive_score_is_the_sum_of_bins_and_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    p = m.score(x[3000:])
    assert np.mean((p > 0) == y[3000:]) > 0.9 and (0, 1) in m.pairs
    b = m.bins(x[:5])
    for i in range(5):
        s = m.intercept + sum(t[b[i, j]] for j, t in enumerate(m.tables)) + sum(g[m.coarse[a][b[i, a]], m.coarse[c][b[i, c]]] for (a, c), g in zip(m.pairs, m.grids))
        assert s == pytest.approx(m.score(x[:5])[i])


def test_first_cuts_of_the_trees_equal_those_of_all_cuts_tried():
    r = np.random.default_rng(9)
    for _ in range(20):
        g, h = r.normal(size=12), r.random(12) + 0.1
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)  # noqa: B023, E731
        best = max(value(0, c) + value(c, 12) for c in range(1, 12))
        tree = quality._tree(g, h, 1, 1.0)
        cut = np.flatnonzero(np.diff(tree)) + 1
        got = value(0, int(cut[0])) + value(int(cut[0]), 12) if len(cut) else value(0, 12)
        assert got == pytest.approx(max(best, value(0, 12)))
        g2, h2 = r.normal(size=(4, 5)), r.random((4, 5)) + 0.1
        block = lambda rows, cols: g2[rows, cols].sum() ** 2 / (h2[rows, cols].sum() + 1)  # noqa: B023, E731
        whole = g2.sum() ** 2 / (h2.sum() + 1)
        gains = [sum(block(a, b) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))) - whole for i in range(1, 4) for j in range(1, 5)]
        assert quality._pair_tree(g2, h2, 1.0)[1] == pytest.approx(max(gains))


def test_quality_features_by_counting():
    text = "The cat.\nThe cat.\nAB 12 !! |"
    f = dict(zip(quality.FEATURES, quality.text_features(pa.array([text, None, ""]))[0]))
    assert f["upper"] == pytest.approx(4 / len(text)) and f["digit"] == pytest.approx(2 / len(text)) and f["bang"] == pytest.approx(2 / len(text))
    assert f["repeated_lines"] == pytest.approx(1 / 3) and f["distinct_words"] == pytest.approx(4 / 6)
    assert not quality.text_features(pa.array([None, ""])).any()


def test_quality_on_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    half = F.xxhash64("doc_id") % 2 == 0
    out = quality.classify_quality(docs, labels.where(half)).join(labels.where(~half).withColumnRenamed("quality", "y"), "doc_id")
    right = out.where((F.col("y") == 1) == F.col("keep")).count() / out.count()
    assert right > 0.93
    assert quality.classify_quality(docs, labels).count() == docs.count()


def test_quality_of_awkward_tables(awkward, nothing, spark):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (4, 0, 0, "x"), (None, 1, 1, "x"), (5, None, None, "x"), (99, 1, 0, "x")], "doc_id long, quality int, toxic int, features string")
    out = quality.classify_quality(awkward, labels)
    assert out.count() == awkward.count() and out.where("quality is null").count() == 0
    assert out.where("doc_id = 4").distinct().count() == 1
    assert quality.classify_quality(nothing, labels).count() == 0
    assert quality.classify_quality(awkward, labels.where("false")).select("quality").distinct().count() == 1


def labelled(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Insults make a sentence toxic; one group is named more often in toxic ones."""
    r = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        toxic = r.random() < 0.4
        group = "muslim" if r.random() < (0.7 if toxic else 0.05) else r.choice(["christian", "jewish", "hindu", "nobody"])
        words = [r.choice("the a of weather report river stone paper day light".split()) for _ in range(12)]
        words.insert(r.randint(0, 12), group)
        if toxic and r.random() < 0.9:
            words.insert(r.randint(0, 12), r.choice(["idiot", "scum", "moron"]))
        texts.append(" ".join(words))
        y.append(toxic)
    return texts, np.array(y, float)


def test_counterfactual_penalty_levels_the_scores_of_groups_and_keeps_accuracy():
    texts, y = labelled(1500, 1)
    free, fair = (toxicity.fit(texts, y, pairs_weight=w) for w in (0.0, 5.0))
    neutral = pa.array([f"the {g} report of the day" for g in ("muslim", "christian", "jewish", "hindu")])
    spread = lambda m: float(np.ptp(np.log(m.score(neutral) / (1 - m.score(neutral)))))
    assert spread(fair) < 0.25 * spread(free)
    test, truth = labelled(600, 2)
    plain = [t.replace("muslim", "nobody") for t, v in zip(test, truth) if not v]
    neutral = [t.replace("nobody", "muslim") for t in plain]
    alarms = lambda m: np.mean(m.score(pa.array(neutral)) >= m.threshold)
    assert alarms(fair) <= alarms(free)
    insult = np.array([any(w in t for w in ("idiot", "scum", "moron")) for t in test])
    assert np.mean((fair.score(pa.array(test)) >= fair.threshold)[insult]) > 0.95


def test_optimum_of_the_penalised_loss_by_dense_coordinates():
    """At the solution no coordinate, changed either way, lowers loss + penalty + L1, worked out on dense matrices."""
    r = np.random.default_rng(3)
    n, k = 80, 6
    x = (r.random((n, k)) < 0.4).astype(float)
    y = (r.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    gained, lost = r.integers(0, k, 30), r.integers(0, k, 30)
    swaps = [np.array([g, -1 - v], np.int32) for g, v in zip(gained, lost)]
    model = toxicity.optimise(y, [np.flatnonzero(row).astype(np.int32) for row in x], swaps, np.arange(k), pairs_weight=1.5, l1=1e-3, steps=6000)
    w = np.zeros(k)
    w[model.features] = model.weights
    d = np.zeros((30, k))
    for i, (g, v) in enumerate(zip(gained, lost)):
        d[i, g] += 1
        d[i, v] -= 1
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))

    def total(w, b):
        s = x @ w + b
        return float(share @ np.logaddexp(0, np.where(y > 0, -s, s)) + 1.5 * np.mean((d @ w) ** 2) + 1e-3 * np.abs(w).sum())

    at = total(w, model.intercept)
    for j in range(k):
        for step in (-0.02, 0.02):
            e = w.copy()
            e[j] += step
            assert total(e, model.intercept) >= at - 1e-6
    assert total(w, model.intercept + 0.02) >= at - 1e-6 and total(w, model.intercept - 0.02) >= at - 1e-6


def test_fit_and_train_are_the_same(spark):
    texts, y = labelled(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    one, two = toxicity.fit(texts, y), toxicity.train(docs, labels)
    assert np.allclose(one.score(pa.array(texts)), two.score(pa.array(texts)), atol=1e-6) and one.threshold == pytest.approx(two.threshold, abs=1e-6)


def test_counterfactuals_swap_terms_of_a_kind():
    before, after = toxicity.counterfactuals(["Old women sing. No term here."])
    assert set(before) == {"old women sing."} and "young women sing." in after and "old men sing." in after and len(before) == 4 + 5
    assert toxicity.counterfactuals(["", "plain"]) == ([], [])


def test_toxicity_on_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    half = F.xxhash64("doc_id") % 2 == 0
    model = toxicity.train(docs, labels.where(half))
    out = toxicity.score(docs, model).join(labels.where(~half).select("doc_id", F.col("toxic").alias("y")), "doc_id")
    assert out.where((F.col("y") == 1) == F.col("toxic")).count() / out.count() > 0.9
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == toxicity.score(docs, model).where("not toxic").count()


def test_toxicity_of_awkward_tables(awkward, nothing, spark):
    labels = spark.createDataFrame([(4, 0, "x"), (5, 1, "x"), (None, 1, "x"), (6, None, "x"), (99, 1, "x")], "doc_id long, toxic int, text string")
    out = toxicity.classify_toxicity(awkward, labels)
    assert out.count() == awkward.count() and out.where("toxicity is null").count() == 0
    assert toxicity.classify_toxicity(nothing, labels).count() == 0
    assert toxicity.classify_toxicity(awkward, labels.where("false")).where("toxic").count() == 0
    model = toxicity.train(awkward, labels)
    kept = toxicity.drop_toxic(awkward, model)
    assert kept.columns == awkward.columns and kept.where("text is null or text = ''").count() == 3


def tree_bits(texts: list[bytes], depth: int) -> dict:
    """Code lengths of (context, byte) by the definition: one recursive weighting for each decision node."""
    counts: dict = {}
    for t in texts:
        for i in range(len(t)):
            context = (b"\0" * depth + t[:i])[-depth:] if depth else b""
            counts[context, t[i]] = counts.get((context, t[i]), 0) + 1

    def kt(n: list) -> float:
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n[0] + n[1] + 1)

    out = {}
    for (context, byte), _ in counts.items():
        bits = 0.0
        for j in range(8):
            prefix, bit = byte >> (8 - j), (byte >> (7 - j)) & 1

            def weigh(suffix: bytes) -> tuple[float, float, list]:
                """log weighted probability, and the log of it had one more ``bit`` come in ``context``."""
                n, more = [0, 0], None
                for (c, b), k in counts.items():
                    if c.endswith(suffix) and b >> (8 - j) == prefix:  # noqa: B023
                        n[(b >> (7 - j)) & 1] += k  # noqa: B023
                more = list(n)
                if context.endswith(suffix):  # noqa: B023
                    more[bit] += 1  # noqa: B023
                if len(suffix) == depth:
                    return kt(n), kt(more)
                children = {c[-len(suffix) - 1 :] for c, b in counts if c.endswith(suffix) and b >> (8 - j) == prefix}  # noqa: B023
                parts = [weigh(c) for c in children]
                both = lambda own, sub: np.logaddexp(own, sub) - math.log(2)
                return both(kt(n), sum(p[0] for p in parts)), both(kt(more), sum(p[1] for p in parts))

            now, then = weigh(b"")
            bits -= (then - now) / math.log(2)
        out[context, byte] = bits
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_ctw_equals_the_recursive_definition(spark, depth):
    texts = ["abracadabra", "abra", "cadabré", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = tree_bits([t.encode() for t in texts], depth)
    got = {r.doc_id: r for r in ctw.score_texts(docs, depth=depth).collect()}
    for i, t in enumerate(texts):
        b = t.encode()
        bits = sum(want[(b"\0" * depth + b[:k])[-depth:] if depth else b"", b[k]] for k in range(len(b)))
        assert got[i].bits == pytest.approx(bits, abs=1e-5) and got[i].n_bytes == len(b)
    assert got[3].bits_per_byte is None


@pytest.mark.parametrize("depth", [2, 6])
def test_ctw_of_long_contexts_equals_the_recursive_definition(spark, depth):
    texts = ["abracadabra", "abra cadabra abra", "cadabré", "", "abracadabra abracadabra"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = tree_bits([t.encode() for t in texts], depth)
    got = {r.doc_id: r.bits for r in ctw.score_texts(docs, depth=depth, chunk_bytes=20).collect()}
    for i, t in enumerate(texts):
        b = t.encode()
        assert got[i] == pytest.approx(sum(want[(b"\0" * depth + b[:k])[-depth:], b[k]] for k in range(len(b))), abs=1e-5)


def test_ctw_tells_bytes_apart_by_six_before(spark):
    texts = ["xabcdey"] * 50 + ["zabcdew"] * 50 + ["xabcdew"]
    got = [r.bits for r in ctw.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[100] > got[0] + 3  # 4-grams say y or w alike


def test_ctw_in_small_chunks_and_on_another_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = {r.doc_id: r.bits for r in ctw.score_texts(docs).collect()}
    many = {r.doc_id: r.bits for r in ctw.score_texts(docs, chunk_bytes=20_000).collect()}
    assert once.keys() == many.keys() and all(abs(once[k] - many[k]) < 1e-4 for k in once)
    other = spark.createDataFrame([(1, "zzqqj 漢字"), (2, None)], "doc_id long, text string")
    odd = {r.doc_id: r.bits_per_byte for r in ctw.score_texts(other, docs).collect()}
    assert odd[1] > 6 and odd[2] is None and np.median([once[k] for k in once]) > 0


def test_ctw_of_awkward_tables(awkward, nothing):
    out = ctw.score_texts(awkward)
    assert out.count() == awkward.count() and out.where("bits_per_byte is null").count() == 3
    assert ctw.score_texts(nothing).count() == 0


def test_messages_are_exact_on_trees():
    m = pii.trained()
    r = np.random.default_rng(2)
    k = len(pii.LABELS)
    unary, edges = r.normal(size=(5, k)), np.array([[0, 1], [1, 2], [1, 3], [3, 4]])
    psi = np.exp(r.normal(size=(4, k, k)))
    total = np.zeros((5, k))
    for y in itertools.product(range(k), repeat=5):
        p = math.exp(sum(unary[i, v] for i, v in enumerate(y))) * np.prod([psi[e, y[a], y[b]] for e, (a, b) in enumerate(edges)])
        for i, v in enumerate(y):
            total[i, v] += p
    assert np.allclose(m.marginals(unary, edges, psi), total / total.sum(1, keepdims=True), atol=1e-6)


def test_two_steps_over_a_hub_are_an_edge_and_loops_come_near_the_truth():
    m = pii.trained()
    k = len(pii.LABELS)
    b = m.to_hub()
    assert np.allclose(b @ b, np.exp(m.skip[:, :, None] * np.eye(k)), rtol=1e-6, atol=1e-9) and (b > 0).all()
    r = np.random.default_rng(4)
    unary, edges = r.normal(size=(4, k)), np.array([[0, 1], [1, 2], [2, 3], [0, 3]])
    psi = np.exp(0.3 * r.normal(size=(4, k, k)))
    total = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        p = math.exp(sum(unary[i, v] for i, v in enumerate(y))) * np.prod([psi[e, y[i], y[j]] for e, (i, j) in enumerate(edges)])
        for i, v in enumerate(y):
            total[i, v] += p
    assert np.abs(m.marginals(unary, edges, psi) - total / total.sum(1, keepdims=True)).max() < 0.02


def test_evidence_reaches_a_mention_whatever_lies_between():
    m = pii.trained()
    between = " ".join(f"and the Word{chr(97 + i % 26)}{chr(97 + i // 26)}x of" for i in range(500))
    text = f"it met Dr. Quillfeather then {between} and the for Quillfeather again"
    found = [text.encode()[a:b].decode() for _, a, b, label, _ in m.spans(pa.array([text])) if label == "NAME"]
    assert found == ["Quillfeather"] * 2


def test_a_stretch_of_plain_words_is_a_power_of_the_transition():
    m = pii.trained()
    g = m.gap_potentials()
    plain = np.diag(np.exp([0.0] + [-pii.PLAIN] * (len(pii.LABELS) - 1)))
    want = np.exp(m.transition)
    for n in range(1, pii.LONGEST_GAP + 1):
        want = want @ plain @ np.exp(m.transition)
        assert np.allclose(g[n] / g[n].max(), want / want.max())
    assert np.allclose(g[-1], g[-2])


def test_skip_edges_carry_evidence_to_distant_mentions():
    m = pii.trained()
    far = " and the ".join(["of it was"] * 30)
    text = pa.array([f"met Dr. Quillfeather {far} said Quillfeather then {far} for Quillfeather again", f"met the Quillfeather {far} then"])
    found = [(r, text[r].as_py()[a:b]) for r, a, b, label, _ in m.spans(text) if label == "NAME"]
    assert found.count((0, "Quillfeather")) == 3 and not [f for f in found if f[0] == 1]


def test_pii_on_held_out_texts():
    m = pii.trained()
    data = pii.generated(400, seed=77)
    column = pa.array([t for t, _ in data])
    got = {(r, len(data[r][0].encode()[:a].decode()), label) for r, a, b, label, _ in m.spans(column)}
    want = {(i, a, label) for i, (_, spans) in enumerate(data) for a, b, label in spans}
    hard = lambda s: {x for x in s if x[2] != "NAME"}
    assert len(hard(got) & hard(want)) / len(hard(want)) > 0.97 and len(hard(got) & hard(want)) / len(hard(got)) > 0.97
    assert len(got & want) / len(got) > 0.9


def test_redaction_changes_only_what_is_private(spark, awkward, nothing):
    text = "Mail bo.12@post3.example.com or call +1 (415) 555-2671; host 10.20.30.40, card 4111111111111111. Version 2.0 of 1999, é."
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "nothing here, 3.5 and 12:30", "en", "s", 27), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "Mail [EMAIL] or call [PHONE]; host [IP], card [CARD]. Version 2.0 of 1999, é." and out[1].n_chars == len(out[1].text)
    assert out[2].text == "nothing here, 3.5 and 12:30" and out[3].text is None
    assert pii.redact(awkward).collect() == awkward.collect()
    assert pii.redact(nothing).count() == 0 and pii.find_pii(nothing).count() == 0
    rows = pii.find_pii(docs).collect()
    assert {text[r.start : r.end] for r in rows} == {"bo.12@post3.example.com", "+1 (415) 555-2671", "10.20.30.40", "4111111111111111"}
    assert pii.find_pii(awkward).count() == 0
    twice = awkward.sparkSession.createDataFrame([(None, "mail bo.12@post3.example.com", 1), (None, "mail bo.12@post3.example.com", 2)], "doc_id long, text string, label int")
    assert [(r.doc_id, r.label) for r in pii.find_pii(twice).collect()] == [(None, "EMAIL")] * 2
