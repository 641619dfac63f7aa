"""The pipeline's stages against their operators' rules, and the SQL checks of the operators."""

import public_tokenizers
import pytest
from conftest import rows

import corpus_pipeline
from tickloom.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, data, duck, name):
    assert rows(q.QUERIES[name](spark, data).toPandas()) == rows(duck.execute(q.ORACLES[name]).df())


def test_stages(spark, data):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, data), name)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    before, after = seen["ngram_jaccard_join"]
    groups = q.ngram_join.jaccard_components(before)
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in groups.collect()}
    before, after = seen["benchmark_decontamination"]
    bad = {r.doc_id for r in q.decontam.scan(before, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = seen["pii"]
    assert after.count() == before.count() and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["best_fit_packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
    assert after.agg({"length": "sum"}).first()[0] == total


@pytest.fixture(scope="module")
def odd(spark, data):
    """Documents with nulls in any column, empty, repeated and long texts, and names that the stages use themselves."""
    good = [r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("lang is not null").collect()][:40]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "x") for r in good]
    rows += [rows[0], rows[1][:1] + (None,) + rows[1][2:], (None, rows[2][1], None, None, None, None, None), (None, None, None, None, None, None, None), (90_001, "", "en", "s", 0, 2, "y"), (90_002, rows[3][1] * 400, "en", "s", 9, 3, None), (90_003, "?!", None, "s", 2, 4, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, found string")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, data, odd, name, stage):
    out = stage(spark, odd, data)
    rows = out.collect()
    assert stage(spark, odd.limit(0), data).count() == 0
    if name == "best_fit_packing":
        assert len({(r.doc_id, r.piece) for r in rows}) == len({r.doc_id for r in rows if r.piece == 0}) + sum(r.piece > 0 for r in {(x.doc_id, x.piece): x for x in rows}.values())
        return
    assert out.columns == odd.columns
    ids = {r.doc_id for r in rows}
    if name == "language_id":
        assert 90_001 not in ids and 90_003 not in ids and 90_002 in ids
    if name == "ngram_jaccard_join":
        assert {90_001, 90_003} <= ids and sum(r.doc_id == rows[0].doc_id and r.text == rows[0].text for r in rows) == 1
    if name == "pii":
        assert len(rows) == odd.count() and sum(r.text is None for r in rows) == 2


def test_pipeline_without_any_language_keeps_texts(spark, data, odd):
    from pyspark.sql import functions as F

    kept = corpus_pipeline.STAGES[0][1](spark, odd.withColumn("lang", F.lit(None).cast("string")), data)
    assert 90_002 in {r.doc_id for r in kept.collect()} and 90_003 not in {r.doc_id for r in kept.collect()}


RESULTS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_quality_lines": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double",
    "op5_license_index": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, n_offending bigint",
    "op7_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_warc_index": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint",
    "op10_bwt_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op11_neighbour_quality": "doc_id bigint, held_out boolean, score double, predicted int, best_similarity double",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_results_of_queries(spark, data, name):
    import zlib

    df = q.QUERIES[name](spark, data)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == RESULTS[name]
    source = spark.read.parquet(f"{data}/{'pages' if name.startswith('op8') else 'documents'}.parquet").toPandas()
    got = df.toPandas()
    key = got.columns[0]
    assert set(got[key]) == set(source[key])
    if name != "op3_best_fit_packing":
        assert len(got) == len(source)
    crc = lambda n: [zlib.crc32(str(i).encode()) % n for i in got["doc_id"]]
    if name == "op1_language_id":
        assert (got["held_out"] == [c == 1 for c in crc(3)]).all() and got["score"].between(0, 1).all()
        truth = source.set_index("doc_id")["lang"]
        some = got[got["held_out"]]
        right = [truth[i] == p for i, p in zip(some["doc_id"], some["lang_pred"]) if truth[i] is not None and p != "und"]
        assert sum(right) >= 0.95 * len(right)
        assert set(got["lang_pred"]) <= set(truth.dropna()) | {"und"}
    if name == "op6_toxicity":
        assert (got["held_out"] == [c == 0 for c in crc(5)]).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
