"""Training of the language and toxicity models against the same rules written out number by number."""

import math
import random

import numpy as np
import pytest

from tickloom.llm import langid, textops, toxicity

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


# ---- 1
def grams(text, buckets):
    """n-grams of one to three characters of a text whose non-letters are blanks, as feature numbers."""
    a, b, c = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
    shift = 32 - buckets.bit_length() + 1
    cs = [ord(x.lower()) if x.isalpha() else 32 for x in text]
    fold = lambda h, by: ((h ^ (h >> 15)) * by & M32) >> shift
    for i, x in enumerate(cs):
        if x != 32:
            yield fold((x * a + 1) & M32, b)
        if i + 1 < len(cs) and (x != 32 or cs[i + 1] != 32):
            yield fold((x * b + cs[i + 1] * c + 2) & M32, a)
        if i + 2 < len(cs) and cs[i + 1] != 32:
            yield fold((((x * a & M32) ^ (cs[i + 1] * b & M32)) * c + cs[i + 2] * a + 3) & M32, b)


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_language_model_number_by_number(spark):
    draw = random.Random(3)
    sounds = {"aa": ["lo", "mi", "na", "li"], "bb": ["krz", "ost", "wie"], "cc": ["ξε", "λο", "πα"]}
    rows = sorted({(" ".join("".join(draw.choices(sounds[k], k=3)) for _ in range(6)) + "!", k) for k in list(sounds) * 5})[:14]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    buckets, alpha, beta, l1, l2, epochs, scale = 1 << 10, 0.3, 1.0, 0.02, 0.1, 2, 20.0
    model = langid.fit(docs, buckets=buckets, epochs=epochs)

    names = sorted(sounds)
    counted = [list(grams(t, buckets)) for t, _ in rows]
    df = [sum(f in set(g) for g in counted) for f in range(buckets)]
    idf = [math.log((1 + len(rows)) / (1 + d)) + 1 for d in df]
    order = np.random.default_rng(1).permutation(len(rows)).tolist()
    samples = [({f: g.count(f) / len(g) * idf[f] * scale for f in set(g)}, names.index(rows[i][1])) for i in order for g in [counted[i]]]
    held, train = samples[: len(rows) // 7], samples[len(rows) // 7 :]
    z, n = ([[0.0] * len(names) for _ in range(buckets)] for _ in range(2))
    weight = lambda f, k: 0.0 if abs(z[f][k]) <= l1 else -(z[f][k] - math.copysign(l1, z[f][k])) / ((beta + math.sqrt(n[f][k])) / alpha + l2)
    for _ in range(epochs):
        for x, y in train:
            w = {(f, k): weight(f, k) for f in x for k in range(len(names))}
            p = softmax([sum(v * w[f, k] for f, v in x.items()) for k in range(len(names))])
            for f, v in x.items():
                for k in range(len(names)):
                    g = v * (p[k] - (k == y))
                    step = (math.sqrt(n[f][k] + g * g) - math.sqrt(n[f][k])) / alpha
                    z[f][k] += g - step * w[f, k]
                    n[f][k] += g * g
    logits = lambda x: [sum(v * weight(f, k) for f, v in x.items()) for k in range(len(names))]
    loss = lambda t: -sum(math.log(softmax([v / t for v in logits(x)])[y] + 1e-12) for x, y in held)
    temperature = min(np.geomspace(0.1, 10, 200).tolist(), key=loss)
    assert loss(model.temperature) == pytest.approx(loss(temperature), abs=1e-4)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, g in enumerate(counted):
        p = softmax([v / model.temperature for v in logits({f: g.count(f) / len(g) * idf[f] * scale for f in set(g)})])
        assert got[i].lang_pred == names[p.index(max(p))] and got[i].score == pytest.approx(max(p), abs=2e-3)


# ---- 6
def mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * by & M64
    return x ^ (x >> 31)


def hashed(raw):
    values = [int(v) for v in textops.byte_values()]
    base = 0x9E3779B97F4A7C15 | 1
    return mixed(sum(values[b] * pow(base, i, 1 << 64) for i, b in enumerate(raw)) & M64)


def bag(text):
    """Feature numbers of every sentence: its words and the stems of longer ones."""
    import re

    out = []
    for sentence in re.split(r"[.!?\n]", text.translate({i: i + 32 for i in range(65, 91)})):
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence)]
        if words:
            shift = 64 - toxicity.BITS
            out.append([hashed(w) >> shift for w in words] + [mixed((hashed(w[:k]) + k) & M64) >> shift for w in words for k in toxicity.STEMS if len(w) > k])
    return out


def softplus(x):
    return max(x, 0) + math.log1p(math.exp(-abs(x)))


def test_noisy_or_number_by_number(spark):
    draw = random.Random(5)
    clean, nasty = ["river", "Stone", "quietly", "windowsill", "paper"], ["nastyword", "vileness"]
    rows, labels = [], []
    for i in range(12):
        sentences = [" ".join(draw.choices(clean, k=3)) for _ in range(draw.randrange(1, 4))]
        if i % 3 == 0:
            sentences[0] += " " + draw.choice(nasty)
        rows.append((i, "? ".join(sentences) + "."))
        labels.append((i, int(i % 3 == 0)))
    rows += [(50, ""), (51, None), (52, "... !")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rate, l1, epochs, batch, least = 0.15, 4e-4, 3, 5, 2
    model = toxicity.fit(docs, known, epochs=epochs, batch=batch, least_docs=least)

    some = sorted((t, y) for (i, t), (_, y) in zip(rows, labels, strict=False))
    bags = [bag(t) for t, _ in some]
    seen = {}
    for b in bags:
        for f in {f for s in b for f in s}:
            seen[f] = seen.get(f, 0) + 1
    bags = [[[f for f in s if seen[f] >= least] for s in b] for b in bags]
    weights, grown, bias, leak, grown_bias, grown_leak = {}, {}, -7.0, -4.0, 1.0, 1.0
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(some)).tolist()
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            slope, slope_bias, slope_leak = {}, 0.0, 0.0
            for i in own:
                zs = [bias + sum(weights.get(f, 0.0) for f in s) for s in bags[i]]
                against = sum(map(softplus, zs)) + softplus(leak)
                pull = (-1 / max(math.expm1(against), 1e-6) if some[i][1] else 1.0) / len(own)
                for s, x in zip(bags[i], zs, strict=True):
                    slope_bias += pull * sigmoid(x)
                    for f in s:
                        slope[f] = slope.get(f, 0.0) + pull * sigmoid(x)
                slope_leak += pull * sigmoid(leak)
            for f, g in slope.items():
                grown[f] = grown.get(f, 1e-4) + g * g
                step = rate / math.sqrt(grown[f])
                w = weights.get(f, 0.0) - step * g
                weights[f] = math.copysign(max(abs(w) - step * l1, 0), w)
            grown_bias, grown_leak = grown_bias + slope_bias**2, grown_leak + slope_leak**2
            bias -= rate * slope_bias / math.sqrt(grown_bias)
            leak -= rate * slope_leak / math.sqrt(grown_leak)
    assert model.bias == pytest.approx(bias) and model.leak == pytest.approx(leak)
    assert {f: w for f, w in enumerate(model.weights.tolist()) if abs(w) > 1e-9} == pytest.approx({f: w for f, w in weights.items() if abs(w) > 1e-9}, rel=1e-6, abs=1e-9)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, t in rows:
        zs = [bias + sum(weights.get(f, 0.0) for f in s) for s in bag(t or "")]
        assert got[i].score == pytest.approx(1 - math.exp(-sum(map(softplus, zs)) - softplus(leak)))
        assert len(got[i].offending) == sum(x >= 0 for x in zs)
