"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from orograph.llm import bpe, exact_dedup, html_text, langid, licenses, packing, quality, queries, simhash, suffix_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row long, label string, KEEP_ID string, length int, `_spans` string"
LONG = " ".join(f"w{i % 7919} the" for i in range(60_000))
ROWS = [
    (1, "the same text of a few words", "en", "a", 28),
    (2, "the same  text of a few words", "en", "a", 29),
    (2, "the same  text of a few words", "en", "a", 29),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "de", "b", 4),
    (None, "a text without an id that stands alone", "en", None, 3),
    (None, None, None, None, None),
    (6, LONG, "en", "a", len(LONG)),
    (7, "12345 --- 67890", "de", "a", 15),
    (8, "der Fluss war in jenem Jahr hoch", "de", "c", 32),
    (9, "licensed under the MIT license. 日本語 🎉", None, "c", 36),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame([(*r, 1, "x", "k", 1, "s") for r in ROWS], DOCS).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(at)
    return spark.read.parquet(at)


P = queries.public_tokenizers
OPERATORS = {
    "exact": exact_dedup.exact_duplicates,
    "pack": lambda d: packing.pack(d, P.path("byte_bpe_50k.json")),
    "simhash": simhash.near_duplicates,
    "licences": licenses.scan,
    "quality": lambda d: quality.assess(d, P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "repeats": suffix_dedup.repeats,
    "bpe": lambda d: bpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "language": langid.identify,
}
ONE_ROW_EACH = ["exact", "simhash", "quality", "bpe", "language"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_a_row_for_each_row(odd, name):
    got = OPERATORS[name](odd)
    count = lambda df: sorted(map(repr, [r[0] for r in df.select("doc_id").collect()]))
    assert count(got) == count(odd)


def test_exact_groups(odd):
    rows = OPERATORS["exact"](odd).collect()
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows}) == 7
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["keep_id"] == by[2]["keep_id"] == 2 and by[1]["group_size"] == 3
    assert by[3]["keep_id"] == by[4]["keep_id"] == by[5]["keep_id"] == 5 and by[4]["group_size"] == 4


def test_exact_index_splits_and_chains(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("t "), F.col("id") % 1000).alias("text")).withColumnRenamed("id", "doc_id")
    small, large = (exact_dedup.exact_duplicates(df, c).select("doc_id", "keep_id", "group_size", "kept", "text_sha256") for c in (10, 10**6))
    assert small.exceptAll(large).count() == 0 and small.where("kept").count() == 1000
    index = exact_dedup.build_index(df, 10)
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 10
    assert index.select("bucket_depth").distinct().count() >= 1


def test_simhash_of_rows_without_words(odd):
    rows = OPERATORS["simhash"](odd).collect()
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {3}


def test_packing_of_empty_texts(odd):
    rows = OPERATORS["pack"](odd).collect()
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    long = [r["length"] for r in rows if r["doc_id"] == 6]
    assert sorted(long)[1:] == [2048] * (len(long) - 1)


def test_language_of_texts_without_a_letter(odd):
    got = {r["doc_id"]: r["lang_pred"] for r in OPERATORS["language"](odd).collect() if r["doc_id"] is not None}
    assert {d for d, p in got.items() if p == "und"} == {3, 4, 5, 7}


def test_repeats_leave_rows_without_an_id_alone(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (None, passage), (2, f"x {passage} y"), (2, f"x {passage} y"), (3, None)], "doc_id long, text string")
    got = {tuple(r) for r in suffix_dedup.repeats(df).collect()}
    assert {r[:5] for r in got} == {(2, 1, 61, 60, 1)}


@pytest.mark.parametrize("stage", [s[0] for s in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_survive(spark, odd, none, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    for df in (odd, none):
        out = run(spark, df, "")
        if stage != "best_fit_packing":
            assert out.columns == df.columns
        rows = out.collect()
        assert bool(rows) == (df is odd)


def test_stages_keep_what_they_should(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r[0] for r in df.select("doc_id").collect()), key=repr)
    assert set(ids(stages["language_id"](spark, odd, ""))) == {1, 2, None, 6, 8, 9}
    assert ids(stages["exact_dedup"](spark, odd, "")).count(2) == 1
    assert None in ids(stages["simhash_near_dedup"](spark, odd, ""))


def test_pages(spark):
    schema = "page_id long, url string, html string, digest string, `exact` int, keep long"
    body = "<p>" + "some words of the page " * 60 + "</p>"
    rows = [(1, None, None, "d", 1, 1), (2, "u", body, "d", 1, 1), (3, "u", body, "d", 1, 1), (3, "u", body, "d", 1, 1), (None, "v", body, None, None, None), (4, "", "", "d", 1, 1), (5, "w", "<p>" + "x " * 200_000, "d", 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = warc.round_trip(df).collect()
    told = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] != 5), key=repr)
    n = len(body)
    assert told == [(0, "response", None, n), (1, "response", None, 0), (2, "revisit", 3, n), (3, "response", None, n), (3, "response", None, n), (4, "response", None, 0)]
    text = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert text[1] == text[4] == "" and text[2] == text[3] and text[2].startswith("some words")
    assert len(text[5]) == 399_999
    empty = spark.createDataFrame([], schema)
    assert warc.round_trip(empty).collect() == html_text.extract(empty).collect() == []


@pytest.mark.parametrize("ids", [(None, None), (7, 7)])
def test_large_pages_with_one_id_or_none_come_back_whole(spark, ids):
    rows = [(i, "u", "x y " * 9000 + end) for i, end in zip(ids, "ab", strict=True)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.round_trip(df).collect()
    assert len({r["payload_digest"] for r in got}) == 2 and {r["payload_bytes"] for r in got} == {36001}


def test_stages_tell_rows_with_one_id_apart(spark):
    """Different texts under one doc_id: no stage loses or cuts one for what another row with its id has."""
    passage = " ".join(f"p{i}" for i in range(60))
    near = passage.replace("p30", "zz")
    other = " ".join(f"q{i}" for i in range(80))
    stages = dict(corpus_pipeline.STAGES)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = lambda df: sorted(r["text"] for r in df.select("text").collect())
    assert texts(stages["exact_dedup"](spark, docs((5, passage, "en"), (5, other, "en"), (1, passage, "en")), "")) == [passage, other]
    assert texts(stages["simhash_near_dedup"](spark, docs((1, " ".join([passage] * 3), "en"), (5, " ".join([passage, near, passage]), "en"), (5, other, "en")), ""))[1:] == [other]
    cut = stages["suffix_array_dedup"](spark, docs((1, passage, "en"), (2, f"x {passage} y", "en"), (2, other, "en")), "")
    assert texts(cut) == [passage, other, "x y"]
    packed = stages["best_fit_packing"](spark, docs((2, passage, "en"), (2, other, "en")), "")
    assert packed.count() == 2


def test_row_keys_don_t_depend_on_how_a_scan_is_split(spark, tmp_path):
    from orograph.llm.common import keyed

    spark.range(4000).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    a = {tuple(r) for r in keyed(df, "f", "p").collect()}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    b = {tuple(r) for r in keyed(df, "f", "p").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert a == b and len({r[1:] for r in a}) == 4000
