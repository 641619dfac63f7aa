"""Neighbour voting, the filter audit and periodic runs, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import filter_audit, neighbour_quality, periodic, textops
from tickloom.llm import queries as q

SCHEMA = "doc_id long, text string, source string, score double, runs string, part string, y int, id int, fails int"


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def odd_rows():
    draw = random.Random(11)
    noise = lambda n: " ".join(f"w{draw.randrange(90)}" for _ in range(n))
    lap = [f"k{i}" for i in range(37)]
    texts = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "a\t" * 25 + "b", " ".join(lap * 3), " ".join(lap * 3)[:-1], noise(50) + "\n" + " ".join(lap * 5 + lap[:9]) + " " + noise(40)]
    texts += ["x y " * 12, "x y " * 11 + "x", ("q r s t u v w " * 3 + "z ") * 4, noise(700), "é " * 60, "Shout LOUD " * 150, "cost $5 | tax", noise(700), noise(250) + " # ", "w" * 300_000 + " end"]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, 0.5, "r", "p", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, texts[13], "s1", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (-7, texts[13], "s0", 1.0, "r", "p", 0, 0, 0), (9, "other text of id nine " * 60, "s2", 1.0, "r", "p", 0, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 13
def runs_brute(w, least=24, times=3):
    """All maximal stretches of every period; of those on the same words the smallest period."""
    found, n = {}, len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_brute(w, runs):
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequences():
    draw = random.Random(3)
    yield from ([], [1], [1] * 23, [1] * 24, [1, 2] * 12, [1, 2, 3] * 8, list(range(8)) * 3, list(range(9)) * 3, list(range(9)) * 3 + [0, 1])
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [0] * 1000
    for _ in range(250):
        out, n = [], draw.randrange(10, 260)
        while len(out) < n:
            lap = [draw.randrange(draw.choice([2, 4, 40])) for _ in range(draw.randrange(1, 45))]
            out += (lap * draw.randrange(1, 9))[: draw.randrange(1, 180)]
        yield out


def test_periodic_runs_of_sequences():
    for w in sequences():
        ids = np.array(w, np.int64)
        hashes = textops.mix(ids.astype(np.uint64) + np.uint64(5))
        assert [tuple(r) for r in periodic.periodic_runs(ids, hashes).tolist()] == runs_brute(w)


def test_periodic_runs_don_t_rest_on_hashes():
    for w in itertools.islice(sequences(), 60):
        ids = np.array(w, np.int64)
        blind = np.full(len(w), 7, np.uint64)  # all spans of a length agree
        assert [tuple(r) for r in periodic.periodic_runs(ids, blind).tolist()] == runs_brute(w)


def test_a_long_text_of_one_word_takes_linear_keys():
    ids = np.zeros(60_000, np.int64)
    assert periodic.periodic_runs(ids, np.full(60_000, 11, np.uint64)).tolist() == [[0, 60_000, 1]]


@pytest.mark.parametrize(("least", "times"), [(24, 3), (40, 4)])
def test_collapse(docs, empty, least, times):
    got = periodic.collapse(docs, least=least, times=times)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = Counter()
    for r in odd_rows():
        w = spaced(r[1])
        runs = runs_brute(w, least, times)
        want[r[0], len(w), tuple(runs), collapsed_brute(w, runs)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got.collect()) == want
    assert periodic.collapse(empty).count() == 0


def test_collapse_of_texts_over_a_slice(spark):
    draw = random.Random(6)
    lap = [f"m{draw.randrange(10**6)}" for _ in range(15_000)]
    w = [f"n{i}" for i in range(500)] + lap * 3 + lap[:77] + ["end"]
    r = periodic.collapse(spark.createDataFrame([(1, "short"), (2, " ".join(w)), (3, "a " * 40)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(x) for x in r[1].runs] == [(500, 45_077, 15_000)] and r[1].collapsed == " ".join(w[:15_500] + ["end"])
    assert r[0].collapsed == "short" and r[2].collapsed == "a"


def test_op13_plants_and_digests(spark, docs, tmp_path):
    folder = str(tmp_path)
    many = spark.createDataFrame([(i, f"t{i} u v w " * (i % 9) + " ".join(f"z{i * j % 71}" for j in range(i % 131))) for i in range(400)], "doc_id long, text string")
    docs.select("doc_id", "text").union(many.where("doc_id > 20")).write.parquet(f"{folder}/documents.parquet")
    got = {}
    for r in q.QUERIES["op13_periodic_runs"](spark, folder).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, t in spark.read.parquet(f"{folder}/documents.parquet").collect():
        w, n = spaced(t), len(spaced(t))
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_brute(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, hashlib.sha256(collapsed_brute(w, runs).encode()).hexdigest())
        assert want in got[i], (i, want, got[i])


# ---- 12
LETTERS = "ABCDE"


def audit_brute(rows, labels):
    owner = {}
    for i, t, *_ in rows:
        if i is not None:
            owner[t or ""] = min(i, owner.get(t or "", i))
    facts = []
    for i, t, part, *_ in rows:
        t, w = t or "", spaced(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and owner[t] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        facts.append((part or "", {f for f in LETTERS if fails[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {f[0] for f in facts}:
        here, lines = [f for f in facts if f[0] == part], []
        for order in itertools.permutations(LETTERS):
            left = here
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                lines.append([part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in here) - len(gone), sum(x[1] == {f} for x in here), sum(x[2] for x in gone), sum(x[3] for x in gone)])
        shapley = Counter()
        for x in lines:
            shapley[x[1][x[2] - 1]] += x[4]
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return out


def test_filter_audit(spark, docs, empty):
    known = [(i, (i % 3) % 2, i % 2) for i in range(20)] + [(3, None, 1), (4, 1, None), (None, 1, 1), (77, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    facts = filter_audit.marks(docs, labels)
    got = filter_audit.audit(facts)
    want = audit_brute(odd_rows(), known)
    assert len(want) == 600 * 4 and Counter(map(tuple, got.collect())) == Counter(want)
    assert filter_audit.audit(filter_audit.marks(empty, labels)).count() == 0
    assert filter_audit.audit(filter_audit.marks(docs, labels.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


def test_every_state_is_walked_once(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    edges = filter_audit.walk(filter_audit.marks(docs, labels)).where("part = 's1'").collect()
    assert len({(r.state, r.filter) for r in edges}) == len(edges)
    assert len({r.state for r in edges}) <= 32 and sum(r.filter is not None for r in edges) <= 80


def test_many_equal_texts_and_a_hot_source(spark):
    rows = [(i, "the same text " * 80 if i % 2 else f"own {i}", "hot" if i % 3 else f"s{i}") for i in range(600)]
    got = filter_audit.audit(filter_audit.marks(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")))
    assert Counter(map(tuple, got.where("part = 'hot'").collect())) == Counter(x for x in audit_brute([r for r in rows if r[2] == "hot" or r[0] == 1], [(5, 1, 1)]) if x[0] == "hot")


# ---- 11
def terms_brute(text):
    data, out = text.encode(), Counter()
    mixed = lambda x: int(textops.mix(np.array([x], np.uint64))[0])
    for i in range(len(data) - 2):
        out[mixed(data[i] | data[i + 1] << 8 | data[i + 2] << 16) % (neighbour_quality.TERMS // 2)] += 1
    kind = lambda b: 1 if 97 <= b <= 122 or b > 127 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b
    words = [m.encode() for m in spaced(text)]
    for w in words:
        before, total = 0, 0
        for b in w:
            if kind(b) != before:
                total += mixed(before << 8 | kind(b) | 1 << 20)
            before = kind(b)
        out[neighbour_quality.TERMS // 2 + mixed(total % (1 << 64)) % (neighbour_quality.TERMS // 4)] += 1
    return out, words


def test_terms_of_a_text():
    texts = ["", "Ab", "The cat!! the cat!! the cat!! 12,5 é", "", "one one two", "plain words only here"]
    raw = [t.encode() for t in texts]
    counts = neighbour_quality.term_counts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    last = 3 * neighbour_quality.TERMS // 4
    repeats = neighbour_quality.REPEAT_TERMS
    for row, t in zip(counts, texts, strict=True):
        want, words = terms_brute(t)
        assert {i: n for i, n in enumerate(row[:last].tolist()) if n} == dict(want)
        again = [sum(n - 1 for n in Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)).values()) for k in neighbour_quality.REPEATED]
        again.append(sum(a == b for a, b in itertools.pairwise(words)))
        assert [int(row[last + i * repeats : last + (i + 1) * repeats].sum()) for i in range(4)] == again


def test_votes_are_those_of_the_nearest(spark):
    draw = np.random.default_rng(2)
    counts = draw.poisson(0.02, (40, neighbour_quality.TERMS))
    counts[7] = 0
    counts[9] = counts[8]
    idf, axes = draw.random(neighbour_quality.TERMS).astype(np.float32), draw.standard_normal((neighbour_quality.TERMS, 6)).astype(np.float32)
    vectors = neighbour_quality._unit(draw.standard_normal((60, 6)).astype(np.float32))
    vectors[1::2] = vectors[::2]  # ties
    votes, good = draw.random(60) + 0.5, draw.random(60) > 0.5
    model = neighbour_quality.Model(idf, axes, vectors, votes, good, 4, 3.0)
    scores, best = model.score(counts)
    for c, s, b in zip(counts, scores, best, strict=True):
        v = [math.log1p(x) * float(w) for x, w in zip(c, idf, strict=True)]
        latent = [sum(x * float(a) for x, a in zip(v, axis, strict=True) if x) for axis in axes.T]
        size = math.sqrt(sum(x * x for x in latent))
        if not size:
            assert (s, b) == (pytest.approx(votes[good].sum() / votes.sum()), 0)
            continue
        cosine = [sum(x * float(y) for x, y in zip(latent, u, strict=True)) / size for u in vectors]
        last = sorted(cosine)[-4]
        weight = [max(x, 0) ** 3 * n if x >= last - 1e-6 else 0 for x, n in zip(cosine, votes, strict=True)]
        want = sum(x for x, g in zip(weight, good, strict=True) if g) / sum(weight) if sum(weight) else votes[good].sum() / votes.sum()
        assert s == pytest.approx(want, abs=1e-4) and b == pytest.approx(max(0, max(cosine)), abs=1e-5)


def test_latent_axes_are_singular_vectors():
    draw = np.random.default_rng(4)
    x = (draw.standard_normal((80, 5)) * [9, 7, 5, 3, 2] @ draw.standard_normal((5, 200)) + 0.01 * draw.standard_normal((80, 200))).astype(np.float32)
    axes, true = neighbour_quality.latent_axes(x, 5), np.linalg.svd(x, full_matrices=False)[2][:5]
    assert np.abs(np.abs(np.linalg.det(true @ axes)) - 1) < 1e-3
    assert neighbour_quality.latent_axes(x[:2], 64).shape == (200, 2)


def test_neighbour_quality(spark, docs, empty):
    draw = random.Random(4)
    words = ["river", "stone", "quiet", "window", "paper", "garden"]
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        rows.append((i, " ".join(draw.choice(words) + ("" if good else draw.choice(["###", "$$", "!!!"])) for _ in range(30)), 0.5, "x"))
        labels += [(i, int(good)), (i, None)]
    table, known = spark.createDataFrame(rows, "doc_id long, text string, score double, y string"), spark.createDataFrame([*labels, (None, 1)], "doc_id long, quality int")
    model = neighbour_quality.fit(table, known.where("doc_id % 5 <> 0"), max_each=60)
    assert 60 <= len(model.votes) <= 240 and model.prior == pytest.approx(0.75, abs=0.02)
    got = neighbour_quality.score(table.where("doc_id % 5 = 0"), model).collect()
    assert sum((r.score >= 0.3) == (r.doc_id % 4 > 0) for r in got) >= 0.95 * len(got)
    odd = neighbour_quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and 0 <= r.best_similarity <= 1 for r in odd)
    assert {r.score for r in odd if r.doc_id in (0, 1)} == {model.prior}
    assert neighbour_quality.score(empty, model).count() == 0
    nothing = neighbour_quality.fit(empty, known)
    assert {r.score for r in neighbour_quality.score(docs, nothing).collect()} == {nothing.prior}
    unlabelled = neighbour_quality.fit(docs, known.limit(0))
    assert {r.score for r in neighbour_quality.score(docs, unlabelled).collect()} == {0.5}


def test_quality_of_held_out_documents(spark, data):
    got = q.QUERIES["op11_neighbour_quality"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out and quality is not null").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.9 and (got["predicted"] == (got["score"] >= 0.3)).all()


# ---- many matches in one text
def test_added_spans_keep_clear_of_base_spans(spark):
    from pyspark.sql import functions as F

    from tickloom.llm import pii

    draw = random.Random(12)
    kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string,added:boolean>>"
    rows = []
    for i in range(12):
        spans = []
        for _ in range(draw.choice([0, 1, 5, 300, 1500])):
            a = draw.randrange(60_000)
            added = draw.random() < 0.5
            spans.append((a, draw.randrange(7), a + draw.choice([1, 7, 40, 900 if i % 3 == 0 else 3]), "k", added))
        rows.append((i, sorted(set(spans))))
    got = spark.createDataFrame(rows, f"id int, spans {kind}").select("id", F.array_sort(pii._apart(F.col("spans"))).alias("kept")).collect()
    for r in got:
        spans = dict(rows)[r.id]
        base = [s for s in spans if not s[4]]
        assert [tuple(k) for k in r.kept] == [s for s in spans if s[4] and not any(b[0] < s[2] and s[0] < b[2] for b in base)]


def test_a_text_with_very_many_matches(spark):
    from tickloom.llm import license_index, pii

    n = 12_000
    part = lambda i: f'{i}, 4111 1111 1111 1111; password = "a8b7c6d5e4f3{i:06d}" ' if i % 2 else f"x{i}@mail.com under the MIT license. "
    text = "".join(map(part, range(n)))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    r = pii.scan(docs).where("doc_id = 1").first()
    assert (r.n_email, r.n_card, r.n_spans) == (n // 2, n // 2, 3 * n // 2)
    clean = re.sub(r"x\d+@mail.com", "[EMAIL]", re.sub(r'"a8b7c6d5e4f3\d+"', '"[SECRET]"', text)).replace("4111 1111 1111 1111", "[CARD]")
    assert pii.redact(docs).where("doc_id = 1").first().text == clean
    found = license_index.scan(docs).where("doc_id = 1").first()
    assert found.n_base == n // 2 and found.labels == "mit"
