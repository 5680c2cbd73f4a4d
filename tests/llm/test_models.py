"""Fitted text models against their likelihoods written out plainly; token figures and bands of the quality rules; an empty pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import SF
from hard import prose, table, texts, words

from creditloom.llm import fertility, hashed, packing, toxicity, weaklabel

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def s(x):
    return 1 / (1 + math.exp(-x))


def rows_of(rng, n, size, per):
    slot = [sorted(rng.sample(range(size), rng.randrange(1, per))) for _ in range(n)]
    return slot, hashed.Sparse(np.concatenate([np.array(r) for r in slot]), np.ones(sum(map(len, slot))), np.array([len(r) for r in slot]))


def test_thresholds_and_weights_are_the_maximum_of_the_likelihood():
    rng = random.Random(3)
    slot, features = rows_of(rng, 300, 8, 5)
    truth = [2.0, -1.0, 0.5, 0.0, 0.0, 1.0, -0.5, 0.2]
    grade = np.array([sum(rng.random() < s(sum(truth[j] for j in r) - c) for c in (0.5, 1.5, 2.5)) for r in slot])
    model = toxicity.fit_cumulative(features, grade, bits=3, rounds=6000, rate=0.1, penalty=0.0)
    share = {True: 0.5 / (grade > 0).sum(), False: 0.5 / (grade == 0).sum()}

    def likelihood(w, cut):
        total = 0.0
        for r, g in zip(slot, grade.tolist(), strict=True):
            eta = sum(w[j] for j in r)
            above = [1.0, *(s(eta - c) for c in cut), 0.0]
            total += share[g > 0] * math.log(max(above[g] - above[g + 1], 1e-300))
        return total

    w, cut = model.weights.tolist(), model.thresholds.tolist()
    assert cut == sorted(cut)
    best = likelihood(w, cut)
    for k in range(8):
        for step in (-0.05, 0.05):
            assert likelihood([x + step * (i == k) for i, x in enumerate(w)], cut) <= best + 1e-5
    for k in range(3):
        for step in (-0.05, 0.05):
            assert likelihood(w, [x + step * (i == k) for i, x in enumerate(cut)]) <= best + 1e-5


def plain_presence(text, bits):
    out = set()
    for word in words(text):
        low = word.lower()
        core = re.sub(r"^[\W_]+|[\W_]+$", "", low) or low
        for mark, n in (("w", None), ("4", 4), ("5", 5)):
            if n is None or len(core) > n:
                out.add(zlib.crc32((mark + core[:n]).encode()) & ((1 << bits) - 1))
    return out


def test_severity_is_the_sum_of_the_chances(spark):
    rng = np.random.default_rng(0)
    model = toxicity.CumulativeLink(rng.normal(size=1 << 12) * 0.05, np.array([0.2, 0.9, 1.4]), 12)
    rows = [t for _, t in texts() if t is None or t.isascii()]
    got = table(spark, list(enumerate(rows))).select("doc_id", toxicity.severity_of("text", model).alias("p")).collect()
    for r in got:
        held = plain_presence(rows[r.doc_id], 12)
        eta = sum(model.weights[k] for k in held)
        want = [s(eta - c) if held else 0.0 for c in model.thresholds]
        assert np.allclose(r.p, want, atol=1e-9)


def test_scorer_is_the_minimum_of_its_loss():
    rng = random.Random(5)
    slot, features = rows_of(rng, 200, 8, 5)
    target = np.array([s(sum((-1) ** j for j in r) + rng.gauss(0, 1)) for r in slot])
    scorer = weaklabel.fit_scorer(features, target, bits=3, rounds=8000, rate=0.2, penalty=1e-3)
    good = target.sum()
    weight = target * (0.5 / good) + (1 - target) * (0.5 / (len(target) - good))

    def loss(w, b):
        total = 0.5e-3 * sum(x * x for x in w)
        for r, y, c in zip(slot, target, weight, strict=True):
            p = s(sum(w[j] for j in r) + b)
            total -= c * (y * math.log(p) + (1 - y) * math.log(1 - p))
        return total

    w, b = scorer.weights.tolist(), scorer.bias
    least = loss(w, b)
    for k in range(8):
        for step in (-0.05, 0.05):
            assert loss([x + step * (i == k) for i, x in enumerate(w)], b) >= least - 1e-6
    assert loss(w, b + 0.05) >= least - 1e-6 and loss(w, b - 0.05) >= least - 1e-6


def test_scores_follow_the_weights():
    rng = np.random.default_rng(1)
    scorer = weaklabel.Scorer(rng.normal(size=1 << weaklabel.BITS), 0.3)
    rows = [t for _, t in texts()]
    slot, value, counts = weaklabel.token_features(pa.array(rows))
    ends = np.cumsum(counts)
    got = scorer.score(pa.array(rows)).to_pylist()
    for k, (end, n) in enumerate(zip(ends, counts, strict=True)):
        part = slice(end - n, end)
        want = s(float((scorer.weights[slot[part]] * value[part]).sum()) + 0.3) if n else 0.0
        assert abs(got[k] - want) < 1e-9
        # shares of words and of shapes each add up to the words over the words and the damping
        total = len(words(rows[k]))
        assert total == 0 or value[part].sum() >= 2 * total / (total + weaklabel.SHRINK) - 1e-9


def plain_tokens(text):
    held, is_byte = fertility.pieces_of(PIECES)
    partial = fertility._partial(BYTES)
    own = words(text)
    by = [i for w in own for i in packing.encoder(BYTES).encode_ordinary(" " + w)]
    ids = [i for w in own for i in held.encode(w)]

    def figures(tokens, odd, size):
        n, times = max(1, len(tokens)), Counter(tokens)
        entropy = -sum(c / n * math.log2(c / n) for c in times.values()) / max(1.0, math.log2(min(n, size)))
        return sum(map(len, own)) / n, sum(bool(odd[i]) for i in tokens) / n, entropy

    return (*figures(by, partial, len(partial)), *figures(ids, is_byte, len(is_byte)))


def test_token_figures_and_bands_equal_plain_ones(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in texts() if len(t or "") < 20_000] + [(100 + i, prose(rng, 70 + i) + " é\U0001F600" * (i % 4)) for i in range(30)]
    got = fertility.quality_rules(table(spark, rows), BYTES, PIECES).collect()
    names = ["byte_fertility", "byte_fallback", "byte_entropy", "piece_fertility", "piece_fallback", "piece_entropy"]
    found = Counter((r.doc_id, *(round(r[n], 9) for n in names)) for r in got)
    assert found == Counter((i, *(round(x + 0.0, 9) for x in plain_tokens(t))) for i, t in rows)
    passing = {}
    for r in got:
        if not r.base_failed:
            passing.setdefault(r.lang, []).append(r)
    for r in got:
        outside = []
        for name, (times, least) in fertility.BANDS.items():
            if not r.base_failed:
                v = sorted(x[name] for x in passing[r.lang])
                low, mid, high = (v[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.5, 0.75))
                floor = least * (mid if name.endswith("fertility") else 1.0)
                if not mid - max((mid - low) * times / 0.6745, floor) <= r[name] <= mid + max((high - mid) * times / 0.6745, floor):
                    outside.append(name)
        assert r.outside == outside and r.kept == (not r.base_failed and not outside)


def test_an_empty_table_goes_through_the_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and "ids" in docs.columns


def test_nulls_long_and_repeated_rows_go_through_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(6)
    long = prose(rng, 12_000, 3000)
    rows = [(None, None), (1, None), (2, ""), (3, long), (3, long), (None, long + " end"), (4, " \n")] + [(10 + i, prose(rng, 160)) for i in range(40)]
    docs = table(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "stage")
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    # one of the three long texts stays, with its smallest id, and every clean text
    assert kept == {3, *range(10, 50)}
    assert docs.where("doc_id = 3").agg({"length": "sum"}).first()[0] == docs.where("doc_id = 3").first().doc_tokens
