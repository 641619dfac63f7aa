"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with FTRL-proximal and elastic-net penalties, then
temperature calibration.

A text is lower-cased, everything but letters becomes a blank, and its n-grams of
one to three characters are hashed into ``buckets`` features.  A feature's value
is its share of the text's n-grams times its inverse document frequency, counted
over *all* training documents.  The weights are fitted on a bounded, hashed sample
of at most ``max_train`` training rows, drawn by language: languages with few rows
are learned whole, the others share the rest evenly, so each gives all of its rows or
``max_train`` by the number of languages, one at least.  A held-back part of the
sample sets the softmax temperature.

Defined cases: null text and texts without a letter are ``und`` with score 0;
without any labelled training text every prediction is ``und``; null languages
are never learned from; repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import textops as tx
UNKNOWN = "und"


def _alphabet() -> np.ndarray:
    """Lower-case form of every BMP letter, 32 for all else."""
    table = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _letters(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray):
    """Code points with non-letters blanked, and row offsets in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    high = points > 0xFFFF
    clean = alphabet[np.where(high, 32, points)]
    for p in np.unique(points[high]).tolist():
        if chr(p).isalpha():
            clean[points == p] = p
    return clean, heads[offsets]


def _grams(clean: np.ndarray, offsets: np.ndarray, buckets: int):
    """(row, feature) of all n-grams that have a letter at their middle or an end."""
    n = len(clean)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.int32)
    letter = clean != 32
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    salt = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
    one = clean * salt[0] + np.uint32(1)
    yield row[letter], ((one ^ (one >> np.uint32(15))) * salt[1] >> shift)[letter]
    if n < 2:
        return
    two = clean[:-1] * salt[1] + clean[1:] * salt[2] + np.uint32(2)
    ok = (row[:-1] == row[1:]) & (letter[:-1] | letter[1:])
    yield row[:-1][ok], ((two ^ (two >> np.uint32(15))) * salt[0] >> shift)[ok]
    if n < 3:
        return
    three = (clean[:-2] * salt[0] ^ clean[1:-1] * salt[1]) * salt[2] + clean[2:] * salt[0] + np.uint32(3)
    ok = (row[:-2] == row[2:]) & letter[1:-1]
    yield row[:-2][ok], ((three ^ (three >> np.uint32(15))) * salt[1] >> shift)[ok]


def _blocks(column, rows=256):
    """Slices of at most ``rows`` rows, so that row-by-feature tables stay small."""
    for row0, row1, data, offsets in tx.pieces(column):
        for a in range(0, row1 - row0, rows):
            b = min(a + rows, row1 - row0)
            yield row0 + a, row0 + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def document_frequencies(texts: DataFrame, text: str, buckets: int) -> np.ndarray:
    """In how many texts each feature occurs; every task sends one count per feature at most."""

    def count(batches):
        total, alphabet = np.zeros(buckets, np.int64), _alphabet()
        for batch in batches:
            for row0, row1, data, offsets in _blocks(batch.column(0)):
                seen = np.zeros((row1 - row0) * buckets, bool)
                clean, at = _letters(data, offsets, alphabet)
                for row, feature in _grams(clean, at, buckets):
                    seen[row.astype(np.int64) * buckets + feature] = True
                total += seen.reshape(-1, buckets).sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["feature", "df"])

    out = np.zeros(buckets)
    for feature, df in texts.select(text).mapInArrow(count, "feature int, df long").groupBy("feature").agg(F.sum("df")).collect():
        out[feature] = df
    return out


class Model:
    """Weights (features by languages), languages and temperature."""

    def __init__(self, languages, weights, temperature, buckets):
        self.languages, self.weights, self.temperature, self.buckets = languages, weights, temperature, buckets

    def logits(self, data, offsets, alphabet):
        """Logits and number of n-grams of each row."""
        rows = len(offsets) - 1
        sums, counts = np.zeros((rows, len(self.languages))), np.zeros(rows)
        clean, at = _letters(data, offsets, alphabet)
        for row, feature in _grams(clean, at, self.buckets):
            counts += np.bincount(row, minlength=rows)
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(row, self.weights[k][feature], minlength=rows)
        return sums / np.maximum(counts, 1)[:, None], counts


def _softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _quotas(totals: dict[str, int], most: int) -> dict[str, int]:
    """Rows to learn of each language: all of a small one, an even share of what is left otherwise."""
    quotas, left = {}, most
    for i, name in enumerate(sorted(totals, key=lambda x: (totals[x], x))):
        quotas[name] = min(totals[name], max(1, left // (len(totals) - i)))
        left -= quotas[name]
    return quotas


def sample(labelled: DataFrame, totals: dict[str, int], most: int, *, text="text", lang="lang", key="doc_id") -> DataFrame:
    """(text, lang) of the rows to learn: those of the least hashes, as many of each language as its quota.

    A share with six deviations to spare is cut by the hash alone, so that only about
    ``most`` rows are shuffled.
    """
    quotas = _quotas(totals, most)
    of = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]
    share = {x: min(1.0, (q + 6 * q**0.5 + 20) / totals[x]) if q < totals[x] else 1.0 for x, q in quotas.items()}
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text), F.lit(7)).alias("hash"))
    some = rows.where(F.pmod("hash", F.lit(1 << 30)) < of({x: round(r * (1 << 30)) for x, r in share.items()}))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash"))
    return some.withColumn("place", place).where(F.col("place") <= of(quotas)).select("text", "lang")


def fit(docs: DataFrame, *, text="text", lang="lang", key="doc_id", max_train=6000, buckets=1 << 14, alpha=0.3, beta=1.0, l1=0.02, l2=0.1, epochs=3, scale=20.0) -> Model:
    """Fit on labelled ``docs``; ``max_train`` bounds the rows that reach the driver."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    totals = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((0, buckets)), 1.0, buckets)
    df = document_frequencies(labelled, text, buckets)
    n = sum(totals.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = [(r[0], languages.index(r[1])) for r in sample(labelled, totals, max_train, text=text, lang=lang, key=key).collect()]
    rows.sort()  # the order rows arrive in doesn't matter
    order = np.random.default_rng(1).permutation(len(rows))
    alphabet, samples = _alphabet(), []
    for i in order.tolist():
        data = np.frombuffer(rows[i][0].encode(), np.uint8)
        truth, rows[i] = rows[i][1], None  # the text isn't needed any more
        clean, at = _letters(data, np.array([0, len(data)]), alphabet)
        counts = sum((np.bincount(f, minlength=buckets) for _, f in _grams(clean, at, buckets)), np.zeros(buckets))
        if counts.any():
            some = np.flatnonzero(counts)
            samples.append((some.astype(np.uint16 if buckets <= 1 << 16 else np.int32), (counts[some] / counts.sum() * idf[some] * scale).astype(np.float32), truth))
    held = samples[: len(samples) // 7]
    k = len(languages)
    z, seen, w = np.zeros((buckets, k)), np.zeros((buckets, k)), np.zeros((buckets, k))
    for _ in range(epochs):
        for some, x, y in samples[len(held) :]:
            zs, ns = z[some], seen[some]
            ws = np.where(np.abs(zs) > l1, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)
            p = _softmax(x @ ws)
            p[y] -= 1
            g = x[:, None] * p
            grown = ns + g * g
            z[some] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * ws
            seen[some] = grown
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(seen)) / alpha + l2), 0.0)
    temperature = 1.0
    if held:
        logits = np.array([x @ w[some] for some, x, _ in held])
        truth = np.array([y for *_, y in held])
        nll = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.1, 10, 200), key=nll))
    return Model(languages, np.ascontiguousarray((w * idf[:, None] * scale).T), temperature, buckets)


def predict(docs: DataFrame, model: Model, *, text="text", carry=("doc_id",)) -> DataFrame:
    """``carry`` columns (whatever their names), then lang_pred and score, of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*(f"carried_{i}" for i in range(len(carry))), "lang_pred", "score"]

    def run(batches):
        alphabet, m = _alphabet(), shared.value
        for batch in batches:
            langs, scores = [], []
            for _, _, data, offsets in _blocks(batch.column(len(carry)), 4096):
                logits, counts = m.logits(data, offsets, alphabet) if m.languages else (None, np.zeros(len(offsets) - 1))
                if logits is None:
                    langs += [UNKNOWN] * len(counts)
                    scores += [0.0] * len(counts)
                    continue
                p = _softmax(logits / m.temperature)
                best = p.argmax(axis=1)
                langs += [m.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), counts.tolist(), strict=True)]
                scores += np.where(counts > 0, p.max(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    front = docs.select(*(F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)), F.col(text).alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in front.schema[: len(carry)])
    out = front.mapInArrow(run, f"{fields}, lang_pred string, score double")
    return out.toDF(*carry, "lang_pred", "score")


def accept(docs: DataFrame, model: Model, *, text="text", least_score=0.5) -> DataFrame:
    """The rows whose text has a language, predicted with at least ``least_score``; all columns kept.

    A model that has seen no language keeps every text with a letter.
    """
    if not model.languages:
        return docs.where(F.col(f"`{text}`").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clear(texts: pa.Array) -> pa.Array:
        """Only texts go to Python, and only verdicts come back."""
        m, alphabet, out = shared.value, _alphabet(), []
        for _, _, data, offsets in _blocks(texts, 4096):
            logits, counts = m.logits(data, offsets, alphabet)
            out.append((counts > 0) & (_softmax(logits / m.temperature).max(axis=1) >= least_score))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(clear(F.col(f"`{text}`")))
