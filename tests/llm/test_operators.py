"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest


from tickloom.llm import bwt_dedup, components, decontam, langid, license_index, line_crf, ngram_join, packing, pii, textops, toxicity, warc_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, score double, spans string, label string, n long"


def texts():
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "ÉPSILON", "zeta7", "eta,", "theta.", "ιώτα", "kappa"]
    make = lambda n: " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(n))
    base = make(120)
    out = [None, "", " \n\t ", "one", "one two three", "???", base, base, base + " tail", base.replace("alpha", "omega", 2), make(60) + "\n" + base[:300], "x" * 30_000, make(9000), "\n".join(["same line here"] * 9), "ab" * 60, "àb  c"]
    out += [make(draw.randrange(5, 80)) for _ in range(30)]
    out += ["Mail a.b@c.org or +1 (499) 555-6503 from 10.0.0.255, card 4111 1111 1111 1111. token = \"abc123def456ghi\"", "Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 0.5, "s", "l", 1) for i, t in enumerate(texts())]
    rows += [rows[6], (None, "row without id " * 9, "en", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


# ---- 2
def jaccard_brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = spaced(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = sorted((root(x), root(y)))
                label[q] = p
    return {i: (len(sets[i][0]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(docs, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = jaccard_brute(rows, k, percent)
    got = ngram_join.jaccard_components(docs, size=k, percent=percent, common=2).collect()
    assert len(got) == docs.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_ngram_join_keeps_one_of_each(spark, docs, empty):
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 7 not in ids and 8 not in ids and ids[6] == 1 and ids[None] == 1
    assert ngram_join.jaccard_components(empty).count() == 0 and ngram_join.one_per_component(empty).count() == 0


def test_ngram_join_judges_rows_by_their_own_text(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, base, "a"), (2, base + " x", "b"), (2, other, "c"), (None, base, "d"), (None, other + " y", "e"), (None, "alone " * 7, "f"), (None, "alone " * 7, "f"), (3, "", "g"), (3, None, "h")]
    # names that the operator uses itself
    docs = spark.createDataFrame([(i, t, x, 1, 2, 3) for i, t, x in rows], "doc_id long, text string, id string, row_key int, key_hash int, h int")
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns
    got = sorted(r.id for r in kept.collect())
    assert got in (["a", "c", "f", "g", "h"], ["a", "e", "f", "g", "h"])


def test_near_copies_in_a_large_group(spark):
    draw = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(draw.randrange(0, 5)):
            own[draw.randrange(150)] = f"m{i}x{draw.randrange(9)}"
        rows.append((i, " ".join(own)))
    want = jaccard_brute(rows, 4, 85)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 7), (None, 3)], "a long, b long")
    labels = {r.id: r.label for r in components.components(edges).collect()}
    assert all(labels[i] == 0 for i in range(41)) and labels[100] == 100


# ---- 3
def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    packed = packing.pack_documents(docs, file, with_ids=True, group=50).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r.doc_id, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048])) for p, s in enumerate(range(0, len(ids), 2048)))
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed.itertuples())
    assert got == want
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert (s["length"].cumsum() - s["length"]).tolist() == s["offset"].tolist() and s["length"].sum() <= 2048
    assert packing.pack_documents(empty, file).count() == 0


def test_packing_tokens_of_any_text(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(1)
    parts = [*"aAbZs9 0.,!?%*$#&|'\"-_()é ÉßİıŞşĞΣσςάА я中文あ\u0301\u0307\u00a0\u200d😀½²ªǅﬁ\n\t", "TAKSİ,", "don't", "’s", "naïve."]
    encode = packing.WordIds(tokenizer, 0)
    for known in (packing.REMEMBERED, 50):
        encode.limit = known
        texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(3000)] + ["TAKSİ,", "x" * 3000 + "."]
        for _, _, data, offsets in textops.pieces(pa.array(texts)):
            ids, lengths = encode(data, offsets)
            at = 0
            for t, n in zip(texts, lengths.tolist(), strict=True):
                assert ids[at : at + n].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], t
                at += n


def test_packing_tokens_of_letters_with_any_mark(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    marks = [chr(c) for c in range(0x300, 0x370)] + ["\u0327", "\u0345", "\u3099", "\u0653"]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÄÉŠΩΣЖ"
    texts = ["J\u030c T\u0308 H\u0331 W\u030a Y\u030a J\u030cim, A\u030aNGSTR\u00d6M"]
    texts += [" ".join(f"{a}{m} x{a}{m}. {a}{m}IM" for m in marks) for a in letters]
    for _, _, data, offsets in textops.pieces(pa.array(texts)):
        ids, lengths = packing.WordIds(tokenizer, 0)(data, offsets)
        at = 0
        for t, n in zip(texts, lengths.tolist(), strict=True):
            assert ids[at : at + n].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], t[:40]
            at += n


def test_packing_fills_sequences(spark):
    rows = [(i, " ".join(["word"] * (37 * i % 600))) for i in range(400)]
    import public_tokenizers

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 2048) + 1
    # the other capacities bind where they are set
    few = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), most_documents=2).toPandas()
    assert few.groupby("sequence_id").size().max() <= 2
    cheap = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), most_cost=600_000, rule="dot").toPandas()
    assert (cheap["length"] ** 2).groupby(cheap["sequence_id"]).sum().max() <= 600_000 and (cheap.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_packing_obeys_every_capacity():
    lengths = np.sort(np.random.default_rng(0).integers(1, 100, 300))[::-1].astype(float)
    for rule in ("norm", "dot"):
        sequence, offset = packing.best_fit(lengths, np.array([100, 3, 9900.0]), np.array([1, 0.1, 0.1]), rule)
        for s in range(sequence.max() + 1):
            own = lengths[sequence == s]
            assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 9900


def test_assemble(spark):
    rows = [(1, 2, [3]), (1, 0, [1, 2]), (2, 0, [9])]
    got = packing.assemble(spark.createDataFrame(rows, "sequence_id long, offset long, ids array<int>")).collect()
    assert {r.sequence_id: r.ids for r in got} == {1: [1, 2, 3], 2: [9]}


# ---- 4
def quality_brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_counts_and_viterbi(docs, empty):
    crf = line_crf.Crf(np.random.default_rng(1).normal(size=(2, line_crf.WIDTH)), np.array([[0.4, -0.3], [-0.2, 0.5]]))
    for r in line_crf.judge(docs, crf).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        want = quality_brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert line_crf.judge(empty, crf).count() == 0
    draw = np.random.default_rng(4)
    for n in (1, 2, 7):
        active = draw.integers(0, line_crf.WIDTH, (n, 10))
        score = crf.scores(active)
        best = max(np.ndindex(*[2] * n), key=lambda p: sum(score[i, y] for i, y in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:])))
        assert tuple(crf.viterbi(active, np.array([n]))) == best


def test_crf_learns_its_labels():
    draw = np.random.default_rng(0)
    make = lambda y: (np.stack([draw.integers(0, 3, 6) + 3 * y] * 2, axis=1), y, np.full(6, y))
    crf = line_crf.train([make(i % 2) for i in range(60)], steps=40)
    assert all((crf.viterbi(a, np.array([6])) == y).all() for a, y, _ in (make(i % 2) for i in range(20)))


def test_crf_finds_lines_of_either_kind_in_one_document():
    # documents have labels, lines don't: a few boilerplate lines in good documents, a few of content in bad ones
    draw = np.random.default_rng(6)

    def make(y):
        lines = np.where(draw.random(12) < 0.15, 1 - y, y)
        return np.stack([draw.integers(0, 3, 12) + 3 * lines, 6 + draw.integers(0, 3, 12)], axis=1), np.full(12, 5), y, lines

    made = [make(i % 2) for i in range(200)]
    crf = line_crf.learn([m[:3] for m in made], 1)
    right = [(crf.viterbi(a, np.array([12])) == lines).mean() for a, _, _, lines in (make(i % 2) for i in range(50))]
    assert np.mean(right) > 0.97
    assert all((2 * (w * own).sum() >= w.sum()) == (y == 1) for (_, w, y, _), own in zip(made, line_crf.line_labels(crf, [m[:3] for m in made]), strict=True))


# ---- 5
def test_license_scan(docs, empty):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in license_index.scan(docs).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        w, places, labels = alnum(r.text), [], set()
        for p, label in phrases.items():
            p = p.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        if (r.text or "").startswith("permission is hereby"):
            assert r.labels == "mit" and r.base_labels == ""
    assert license_index.scan(empty).count() == 0


# ---- 7
def test_decontamination(spark, docs, empty):
    some = [r.text for r in docs.collect() if r.text and len(r.text) > 300][:3]
    items = spark.createDataFrame([(i, " ".join(t.split()[5:30])) for i, t in enumerate(some)] + [(9, "one two three"), (10, ""), (11, None), (12, "one two three")], "item_id long, text string")
    windows = defaultdict(set)
    for r in items.collect():
        w = alnum(r.text)
        for i in range(len(w) - min(13, len(w)) + 1):
            if w:
                windows[tuple(w[i : i + 13])].add(str(r.item_id))
    for block in (1 << 20, 40):
        for r in decontam.scan(docs, items, block_bytes=block).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
            w, hit, ids = alnum(r.text), set(), set()
            for i in range(len(w)):
                for n in {len(k) for k in windows}:
                    if tuple(w[i : i + n]) in windows and i + n <= len(w):
                        hit.update(range(i, i + n))
                        ids |= windows[tuple(w[i : i + n])]
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(ids))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    kept = decontam.remove_documents(docs, items)
    assert kept.columns == docs.columns and 4 not in {r.doc_id for r in kept.collect()}
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, items).collect()}
    assert cut[4] == "" and cut[5] == "???"
    assert decontam.scan(empty, items).count() == 0 and decontam.scan(docs, items.limit(0)).where("contaminated").count() == 0


# ---- 8
def test_warc_round_trip(spark, tmp_path):
    big, tricky = "<p>é</p>" * 200, "a\r\n\r\nWARC/1.1\r\nx" * 90
    rows = [(1, "http://B.example.com/a?x#f", big, 1), (2, "https://a.example.com/", big, 1), (3, None, big, 1), (4, "http://a.example.com/", "small", 1), (5, "http://a.example.com/", "small", 1), (6, "u", None, 1), (7, "v", tricky, 1), (7, "v", tricky, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, ts long")
    got = warc_index.archive_pages(pages, per_archive=2, per_partition=3)
    lines = got.collect()
    want = {1: ("revisit", "3"), 2: ("revisit", "3"), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert len(lines) == 8 and all((r.record_type, r.refers_to) == want[int(r.page_id)] for r in lines)
    assert all(r.payload_digest == hashlib.sha1((rows[int(r.page_id) - 1][2] or "").encode()).hexdigest() and r.payload_bytes == len((rows[int(r.page_id) - 1][2] or "").encode()) for r in lines)
    keys = [(r.url_key, r.ts, r.archive, r.at) for r in lines]
    assert keys == sorted(keys)
    assert warc_index.archive_pages(pages.limit(0)).count() == 0


def test_loser_tree():
    draw = random.Random(1)
    for k in (0, 1, 2, 3, 8, 13):
        runs = [sorted(draw.randrange(50) for _ in range(draw.randrange(0, 20))) for _ in range(k)]
        assert list(warc_index.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_runs_are_opened_when_they_are_due():
    draw = random.Random(2)
    for k in (0, 1, 5, 40):
        runs = sorted(sorted(draw.randrange(200) for _ in range(draw.randrange(1, 20))) for _ in range(k))
        opened = []

        def coming(runs=runs, opened=opened):
            for r in runs:
                opened.append(r[0])
                yield r

        got = []
        for line in warc_index.merged_as_they_come(coming(), key=lambda x: x):
            got.append(line)
            assert sum(x > line for x in opened) <= 1  # one run is looked at ahead, none is held
        assert got == sorted(x for r in runs for x in r)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    import gzip
    import glob

    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", chr(97 + i % 26) * (50 * 4 ** (i % 5))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc_index.write_archives(pages, str(tmp_path / "w"), per_archive=8, archive_bytes=4000)
    sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{tmp_path}/w/*/part-*.gz")]
    # headers come on top of payloads; the largest payloads are over the bound alone
    assert max(sizes) <= 50 * 4**4 + 700 and sorted(sizes)[-13] <= 4000 + 8 * 700
    index = warc_index.read_archives(spark, str(tmp_path / "w"))
    assert sorted(int(r.page_id) for r in index.collect()) == list(range(60))


def test_a_range_with_many_runs_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "CHUNK", 4)
    pages = spark.createDataFrame([(i, f"http://h{i * 7 % 5}.org/{i * 13 % 97}", f"page {i}") for i in range(400)], "page_id long, url string, html string").repartition(6)
    lines = warc_index.archive_pages(pages, per_archive=20, per_partition=150).collect()
    keys = [(r.url_key, r.ts, r.archive, r.at) for r in lines]
    assert keys == sorted(keys) and sorted(int(r.page_id) for r in lines) == list(range(400))


# ---- 9
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def test_pii(spark, docs, empty):
    odd = ["A@b.c%d@e.f a@b..c x@y.z- +1+1 (555) 123-4567 001.002.3.0255 1.2.3.4.5.6.7.8 4111-1111-1111-1111x é@ü.de a.b@c.d.", "1 " * 3000 + "2", "a" * 30_000 + "@b.c", "a.b@c" + ".d" * 3000, "1.2." * 900, "+" + "1 " * 900]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    body = {r.doc_id: r.text for r in table.collect()}
    for r in pii.scan(table).collect():
        found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, body[r.doc_id] or "") if valid(name, m[0])]
        counts = Counter(k for _, k, _ in found)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest()
        assert {x for *_, x in found} <= set(r.spans.split(",")) | {""}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[0] is None and got[1] == "" and got[46].startswith("Mail [EMAIL] or [PHONE] from [IP], card [CARD].")
    assert pii.scan(empty).count() == 0


def test_pii_secrets_after_a_keyword_in_any_case(spark):
    words = ["token", "TOKEN", "Token", "SECRET", "API_KEY", "Apikey", "PASSWORD", "Passwd"]
    docs = spark.createDataFrame([(i, f'set {w} = "9233A8EC77b1d0f2" now') for i, w in enumerate(words)], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.scan(docs).collect()} == {i: f"secret:{len(w) + 8}:{len(w) + 24}" for i, w in enumerate(words)}
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {i: f'set {w} = "[SECRET]" now' for i, w in enumerate(words)}


def test_pii_in_a_text_full_of_numbers(spark):
    text = "".join(f"{i}, 4111 1111 1111 1111; " if i % 3 == 0 else f"{i} x " for i in range(16_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cards = [m for m in re.finditer(PATTERNS["card"], text) if valid("card", m[0])]
    r = pii.scan(docs).first()
    assert r.n_card == len(cards) == r.n_spans
    assert r.spans == ",".join(f"card:{m.start()}:{m.end()}" for m in cards)
    want, at = [], 0
    for m in cards:
        want += [text[at : m.start()], "[CARD]"]
        at = m.end()
    assert pii.redact(docs).first().text == "".join(want) + text[at:]


def test_pii_added_spans_on_held_out_texts(spark):
    # planted secrets and numbers are found, placeholders and ordinary numbers are left alone
    draw = random.Random(4)
    token = lambda: "".join(draw.choices("0123456789abcdef", k=draw.choice([32, 40])))
    rows, want = [], {}
    for i in range(400):
        kind = draw.choice(["secret", "decoy", "number", "ssn", "plain"])
        value = {"secret": token(), "decoy": draw.choice(["x" * 32, "your_token_example_1", "0" * 32]), "number": str(draw.randrange(10**6)), "ssn": f"{draw.randrange(100, 600)}-{draw.randrange(10, 99)}-{draw.randrange(1000, 9999)}", "plain": "nothing"}[kind]
        front = {"secret": 'the token = "', "decoy": 'the token = "', "number": "about ", "ssn": "her ssn: ", "plain": ""}[kind]
        rows.append((i, f'{front}{value}" and more'))
        want[i] = kind in ("secret", "ssn")
    got = {r.doc_id: r.n_spans for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, clean = [got[i] > 0 for i in want if want[i]], [got[i] == 0 for i in want if not want[i]]
    assert sum(found) >= 0.98 * len(found) and sum(clean) >= 0.98 * len(clean)


def test_pii_clashing_names_and_empty_tables(spark):
    rows = [("a@b.com", 1, "x", "y"), (None, 2, None, None), ("", None, "x", "y")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, found string, base string")
    clean = pii.redact(docs.withColumnRenamed("base", "id"))
    assert clean.columns == ["text", "doc_id", "found", "id"] and {r.text for r in clean.collect()} == {"[EMAIL]", None, ""}
    assert pii.redact(docs.limit(0)).count() == 0


def test_reliabilities_prefer_agreeing_votes():
    counts = [("card", "1,1,1,1", "a", 50), ("card", "-1,1,-1,0", "b", 200), ("card", "1,1,1,0", "a", 40)]
    posterior, _ = pii.reliabilities(counts)
    assert posterior["card", "1,1,1,1"] > 0.9 > 0.1 > posterior["card", "-1,1,-1,0"]
    assert pii.classifier(counts, posterior)["card", "a"] > 0.5


# ---- 10
def repeats_brute(rows, minimum=50):
    first = {}
    for i, t in rows:
        for k in range(len(t) - minimum + 1):
            first[t[k : k + minimum]] = min(i, first.get(t[k : k + minimum], i))
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - minimum + 1):
            if first[t[k : k + minimum]] < i:
                gone[k : k + minimum] = True
        yield i, (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())


@pytest.mark.parametrize("crowd", [1000, 2])
def test_repeated_strings(docs, empty, crowd):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect() if r.doc_id is not None]
    want = dict(repeats_brute(rows))
    got = bwt_dedup.repeated_spans(docs, crowd=crowd, per_bucket=50).collect()
    assert len(got) == docs.count()
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert bwt_dedup.repeated_spans(empty).count() == 0


def test_repeated_strings_in_groups_of_several_buckets(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect() if r.doc_id is not None]
    want = dict(repeats_brute(rows))
    got = bwt_dedup.repeated_spans(docs, per_bucket=5, groups=3).where("doc_id is not null").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_table_of_repeated_anchors_follows_the_input():
    # about one segment in 18 bytes of text, a bit for each
    assert all(1 << bwt_dedup._anchor_bits(size) >= size // 18 for size in (0, 10**6, 10**9, 10**10))
    assert bwt_dedup._anchor_bits(10**14) == bwt_dedup.MOST_ANCHOR_BITS


def test_repeated_strings_of_crowded_anchors_are_dealt_by_longer_ones(spark):
    draw = random.Random(8)
    common = "the same twenty-odd bytes here "
    word = lambda n: "".join(draw.choice("abc") for _ in range(n))
    heads, tails = [word(k) for k in (20, 30, 40, 60)], [word(k) for k in (25, 35, 45, 70)]
    rows = [(i, draw.choice(heads)[-draw.randrange(5, 61) :] + common + draw.choice(tails)[: draw.randrange(5, 71)]) for i in range(300)]
    want = dict(repeats_brute([(i, t.encode()) for i, t in rows]))
    got = bwt_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), crowd=2, most_strings=3).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_repeated_strings_of_texts_longer_than_a_block(spark):
    draw = random.Random(9)
    noise = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    shared = noise(5000)
    long = noise(textops.SLICE_BYTES - 2500) + shared + noise(textops.SLICE_BYTES) + shared + noise(100)
    rows = [(3, long), (1, noise(40) + shared[:3000]), (2, "é" * 40 + shared[-2600:] + noise(9)), (4, long[1000:]), (5, shared[10:70])]
    want = dict(repeats_brute([(i, t.encode()) for i, t in rows]))
    got = bwt_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_interval_expansion():
    draw = np.random.default_rng(0)
    for n in range(60):
        strings = [bytes(draw.integers(97, 98 + n % 3, draw.integers(1, 50)).astype(np.uint8)) for _ in range(draw.integers(1, 10))]
        m = int(draw.integers(7, 16))
        got = bwt_dedup.repeated(np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]), m)
        count, names, at = Counter(s[i : i + m] for s in strings for i in range(len(s) - m + 1)), {}, 0
        for s in strings:
            for i in range(len(s)):
                w = s[i : i + m]
                assert got[at] == (names.setdefault(w, got[at]) if len(w) == m and count[w] > 1 else -1)
                at += 1
        assert len(set(names.values())) == len(names) and -1 not in names.values()


# ---- 1 and 6
def test_language_id(spark, docs, empty):
    draw = random.Random(3)
    sounds = {"aa": ["lo", "mi", "na"], "bb": ["krz", "ost", "wie"], "cc": ["ξε", "λο", "πα"]}
    rows = [(i, " ".join("".join(draw.choices(sounds[k], k=3)) for _ in range(20)), k, k) for i in range(240) for k in [draw.choice(list(sounds))]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(table.where("doc_id % 3 <> 1"))
    held = langid.predict(table.where("doc_id % 3 = 1"), model, carry=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[5].lang_pred == "und" and odd[0].score == 0 and 0 <= odd[3].score <= 1
    assert langid.accept(table, model).columns == table.columns
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_id_learns_a_rare_language(spark):
    common, rare = "the cat and the dog went to the house", "žluťoučký kůň příšerně úpěl ďábelské ódy"
    table = spark.createDataFrame([(i, f"{rare} {i % 7}" if i % 100 == 0 else f"{common} {i % 11}", "cs" if i % 100 == 0 else "en") for i in range(3000)], "doc_id long, text string, lang string")
    totals = {"cs": 30, "en": 2970}
    drawn = [r.lang for r in langid.sample(table, totals, 60).collect()]
    assert (drawn.count("cs"), drawn.count("en")) == (30, 30)
    assert langid._quotas({"a": 5, "b": 100, "c": 90}, 60) == {"a": 5, "b": 28, "c": 27}
    assert {r.lang for r in langid.sample(table.withColumn("doc_id", table.doc_id * 0), totals, 6).collect()} == {"cs", "en"}
    model = langid.fit(table, max_train=60)
    assert {r.lang_pred for r in langid.predict(table.where("lang = 'cs'"), model).collect()} == {"cs"}



def test_toxicity(spark, docs, empty):
    draw = random.Random(4)
    clean = ["river", "stone", "quiet", "window", "paper", "garden"]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(draw.choices(clean, k=5)) for _ in range(4)]
        bad = i % 3 == 0
        if bad:
            sentences[draw.randrange(4)] += " nastyword"
        rows.append((i, ". ".join(sentences), 9.0))
        labels += [(i, int(bad)), (i, None)]
    table, known = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, known.where("doc_id % 5 <> 0"), epochs=30)
    got = toxicity.score(table.where("doc_id % 5 = 0"), model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got) >= 0.95 * len(got)
    hit = next(r for r in got if r.doc_id == 0)
    span = hit.offending[0]
    assert "nastyword" in rows[0][1][span.start : span.end]
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, known).leak == -4.0


def test_no_session_files_are_imported_by_the_rest():
    root = os.path.join(os.path.dirname(__file__), "..", "..", "tickloom")
    for folder, _, files in os.walk(root):
        if "llm" not in folder:
            assert not any("llm" in open(os.path.join(folder, f)).read() for f in files if f.endswith(".py"))


def test_words_don_t_span_rows():
    data, offsets = np.frombuffer(b"abcd ef", np.uint8), np.array([0, 2, 2, 7])
    start, end, row = textops.words(data, offsets, textops.SPACED)
    assert list(zip(start, end, row)) == [(0, 2, 0), (2, 4, 2), (5, 7, 2)]


def test_rows_meet_in_their_first_common_block_only(spark):
    from pyspark.sql import functions as F

    from tickloom.llm import ngram_join as nj
    from tickloom.llm.shared import bit_table

    # two rows with runs of common columns, columns of their own and columns of a third row between them
    lists = {1: [2, 3, 5, *range(10, 60), 61, *range(70, 90)], 2: [1, 3, 4, 5, *range(10, 60), *range(70, 90), 95], 3: [4, 61, 95]}
    classes = spark.createDataFrame([(i, len(g), g) for i, g in lists.items()], "id long, n long, grams array<long>")
    repeated = classes.select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count > 1")
    entries = nj._entries(classes, spark.sparkContext.broadcast(bit_table(repeated, "gram", 20)))
    found = {(r["id"], r["gram"]): r["before"] for r in entries.collect()}
    shared = {g for g in sum(lists.values(), []) if sum(g in other for other in lists.values()) > 1}
    for i, grams in lists.items():
        kept = [g for g in grams if g in shared]
        assert all(found[i, g] == kept[max(k - nj.BEFORE, 0) : k] for k, g in enumerate(kept))
    x, y = entries.alias("x"), entries.alias("y")
    met = x.join(y, F.expr("x.gram = y.gram and x.id < y.id"))
    assert met.count() == 75 and sorted(map(tuple, met.where("not arrays_overlap(x.before, y.before)").select("x.id", "y.id", "x.gram").collect())) == [(1, 2, 3), (1, 3, 61), (2, 3, 4), (2, 3, 95)]
