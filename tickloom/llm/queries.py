"""One thin query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, decontam, filter_audit, langid, license_index, line_crf, neighbour_quality, ngram_join, packing, periodic, pii, toxicity, warc_index
from .shared import remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the ids; ``und`` and score 0 without a letter."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles and the smallest id reachable over similarities of 85 percent."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of every document in sequences of 2,048; empty texts are one piece of one id."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line labels; null texts fail."""
    docs = table(spark, sf_dir, "documents")
    crf = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge(docs, crf).drop("line_labels")


def op5_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document; null texts have none."""
    return license_index.scan(table(spark, sf_dir, "documents")).drop("matches")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the ids, and how many sentences offend."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in benchmark windows, the items, and the verdict."""
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of the archives, read back through their index."""
    history = warc_index.archive_pages(table(spark, sf_dir, "pages"), per_archive=1000)
    return history.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of base kinds, all spans and how many they are."""
    return pii.scan(table(spark, sf_dir, "documents")).drop("found")


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier one has in a run of fifty, and what is left."""
    return bwt_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("ranges")


def op11_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its nearest labelled documents, learned from four fifths of the ids."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = neighbour_quality.fit(docs, labels.where(~held_out))
    scored = neighbour_quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "best_similarity")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders: what each step keeps and removes in every source."""
    return filter_audit.audit(filter_audit.marks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the ids have the words from a place on repeated with a period, both from the id's checksum."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w):
        n = F.size(w).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(moved, " "))

    # the lambda's variable holds the words: they are split once
    planted = F.get(F.transform(F.array(split), repeated), F.lit(0))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document, the strongest of them, and what is left without repeats."""
    found = periodic.collapse(_planted_runs(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", periodic.strongest(F.col("runs")))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_jaccard, op3_best_fit_packing, op4_quality_lines, op5_license_index, op6_toxicity, op7_decontamination, op8_warc_index, op9_pii, op10_bwt_dedup, op11_neighbour_quality, op12_filter_audit, op13_periodic_runs)}

ORACLES = {
    "op12_filter_audit": """
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), o AS (
    SELECT t, min(doc_id) AS owner FROM d GROUP BY t
), w AS (
    SELECT doc_id, part, t, owner, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d JOIN o USING (t)
), l AS (
    SELECT doc_id, max(coalesce(quality, 0)) = 1 AS good, max(coalesce(toxic, 0)) = 1 AS toxic FROM labels GROUP BY doc_id
), m AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
           + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
           + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(owner < doc_id, false) AS INT) AS fails
    FROM w LEFT JOIN l USING (doc_id)
), f(letter, bit) AS (
    VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), p AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), s AS (
    SELECT filter_order, step, f.letter, f.bit, (SELECT coalesce(sum(x.bit), 0) FROM f x WHERE instr(filter_order, x.letter) < step) AS before
    FROM p, (SELECT unnest(range(1, 6)) AS step) n JOIN f ON substr(filter_order, step, 1) = f.letter
), e AS (
    SELECT DISTINCT letter, bit, before FROM s
), c AS (
    SELECT part, letter, before, count(*) FILTER (fails & (before | bit) = 0) AS kept, count(*) FILTER (fails & before = 0 AND fails & bit > 0) AS removed,
           count(*) FILTER (fails & before > 0 AND fails & bit > 0) AS redundant, count(*) FILTER (fails = bit) AS unique_fails,
           count(*) FILTER (fails & before = 0 AND fails & bit > 0 AND good) AS good_lost, count(*) FILTER (fails & before = 0 AND fails & bit > 0 AND toxic) AS toxic_lost
    FROM m, (SELECT letter, bit, CAST(before AS INT) AS before FROM e) GROUP BY part, letter, before
)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s JOIN c USING (letter, before)""",
    "op10_bwt_dedup": """
WITH t AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
    SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM t, unnest(range(0, n - 49)) AS u(i) WHERE n >= 50
), f AS (
    SELECT s, min(doc_id) AS f FROM w GROUP BY s HAVING count(*) > 1
), g AS (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN f USING (s) WHERE f < doc_id
), r AS (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g
), s AS (
    SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run
), k AS (
    SELECT s.*, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s
), e AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
    FROM k JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN e.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN e USING (doc_id)""",
    "op2_ngram_jaccard": """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + least(4, len(w)) - 1], ' ') AS g
    FROM w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS t(k) WHERE len(w) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), r AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op8_warc_index": """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), k AS (
    SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k""",
    "op7_decontamination": """
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS s
    FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(k) WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT n FROM iw
), dw AS (
    SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
    FROM w, sizes, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n
), m AS (
    SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s
), h AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id
), it AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
