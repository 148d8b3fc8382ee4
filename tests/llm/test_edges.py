"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and
clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import chat, decontaminate, fixity, licenses, media, mixing, near_dedup, secrets, token_shards, toxicity
from ledgerfold.llm.common import shared_path

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "plain words in a text of some length", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4),
    (5, LONG, "en", "b", len(LONG)), (6, "plain words in a text of some length", "en", "a", 5), (6, "plain words in a text of some length", "en", "a", 5),
    (None, "no identifier", "en", "c", 3), (7, "ünïcödé – ✓ 日本 words", "de", "c", 3), (8, "x", "en", "c", 1),
]
CLASH = ["id", "key", "n", "rep", "start", "slot", "kept", "block", "stream", "h1", "comp", "a", "b", "score", "f", "y", "shard", "size", "archive", "conv", "control", "hits", "items", "base", "spans", "range", "source_", "record_id"]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return clashing(spark.createDataFrame([(1, "words in a text"), (2, None), (None, "identifier"), (3, "")], "item_id bigint, text string"))


def labels(spark, rows):
    return clashing(spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int"))


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))


def test_licenses(docs, empty):
    rows = licenses.scan_licenses(docs).collect()
    assert ids(rows) == ALL and all(r.matches == [] for r in rows)
    assert {r.doc_id: r.n_sentences for r in rows}[2] == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_fixity(spark):
    rows = [(1, "http://a", "<p>x"), (1, "http://a", "<p>x"), (None, None, None), (2, "", LONG)]
    pages = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    records = fixity.cut(fixity.warc_records(pages), "records")
    found = fixity.audit(records, records)
    assert records.count() == 4 and found["findings"].count() == 0
    assert all(r.intact for r in found["roots"].collect())
    none = fixity.cut(fixity.warc_records(pages.where("false")), "records")
    assert fixity.audit(none, none)["findings"].count() == 0
    extra = fixity.audit(none, records)["findings"]
    assert {r.problem for r in extra.collect()} == {"extra"} and extra.count() == 4


def test_secrets(docs, empty):
    rows = secrets.scan_secrets(docs).collect()
    assert ids(rows) == ALL and all(r.base == [] for r in rows)
    assert secrets.scan_secrets(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, None, "assistant", "</turn>\n### user: x"), (2, None, "assistant", ""), (2, 0, "a: b", "\\h \\\\ \\l###")]
    turns = clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert set(got) == {1, 2, None} and all(r.round_trips for r in got.values())
    assert [(t.role, t.text) for t in got[1].parsed] == [("user", "hi"), ("user", "hi"), ("", "")]
    assert [(t.role, t.text) for t in got[2].parsed] == [("assistant", ""), ("a: b", "\\h \\\\ \\l###")]
    assert got[None].loss_text == "</turn>\n### user: x" and got[None].mode == 1
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_decontaminate(docs, empty, benchmark):
    rows = decontaminate.decontaminate(docs, benchmark).collect()
    assert ids(rows) == ALL
    by = {r.doc_id: r for r in rows}
    assert by[1]["items"] == ["1"] and [(h.start, h.end) for h in by[1].hits] == [(1, 5)]
    assert by[None]["items"] == ["null"] and by[2].n_words == by[3].n_words == by[4].n_words == 0
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert not any(r.hits for r in decontaminate.decontaminate(docs, benchmark.where("false")).collect())
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7, 8]


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and {r.stream for r in rows} == {"", "a", "b", "c"}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_toxicity(spark, docs, empty):
    for rows in ([], [(1, 1, None), (None, 0, 1)], [(1, 1, 1), (1, 1, 1), (7, 1, 0), (6, 0, 0), (8, 0, 1)]):
        model = toxicity.fit(docs, labels(spark, rows))
        scored = toxicity.score(docs, model).collect()
        assert ids(scored) == ALL and all(0 <= r.score <= 1 for r in scored)
        by = {}
        for r in scored:
            assert by.setdefault(r.doc_id, r.score) == r.score  # repeated rows score alike
        assert toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(docs, toxicity.seed_model()).columns == docs.columns


def test_token_shards(docs, empty):
    rows = token_shards.encode_documents(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == ALL
    assert {r.doc_id: r.n_tokens for r in rows}[2] == 1
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert token_shards.encode_documents(empty).count() == 0


def test_media(spark, docs, empty):
    def stored(df):
        path = shared_path(spark, "media")
        media.write_archives(df, path)
        return media.media_features(media.read_archives(spark, path))

    rows = stored(docs).collect()
    assert ids(rows) == ALL and not any(r.error for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_bytes == 0 and by[2].payload_bytes == 64 and by[2].media_sha256 == by[3].media_sha256
    assert by[1].feature == by[6].feature
    assert stored(empty).count() == 0


def test_near_duplicates(docs, empty):
    rows = near_dedup.near_duplicates(docs).collect()
    assert ids(rows) == ALL
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 1 and not by[6].kept and by[1].kept
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].kept and by[3].kept
    assert by[8].n_shingles == 1 and by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and ids(kept.collect()) == [None, 1, 2, 3, 4, 5, 7, 8]


def test_pipeline_on_odd_tables(spark, docs, empty, benchmark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns in every table,
    then empty tables."""
    import corpus_pipeline

    more = docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(20).cast("bigint")))
    known = labels(spark, [(1, 1, 0), (7, 1, 1), (None, 0, 1), (1, 1, 0), (8, 0, None), (2, 0, 0), (4, 0, 0), (5, 0, 0)])
    for name, (d, l, b) in {"odd": (more, known, benchmark.where("item_id = 1")), "bare": (empty, known.where("false"), benchmark.where("false"))}.items():
        folder = f"{tmp_path}/{name}"
        for part, df in (("documents", d), ("labels", l), ("benchmark", b)):
            df.write.parquet(f"{folder}/{part}.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        if name == "bare":
            assert got == []
            continue
        # 1, 6 and 20 hold the benchmark's words; 6 and 20 are copies of 1 besides.
        assert set(ids(got)) <= {None, 2, 3, 4, 5, 7, 8} and len(got) >= 4
        assert all(r.n_tokens >= 1 for r in got)
        stage = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert ids(stage.collect()) == [None, 1, 2, 3, 4, 5, 7, 8] and stage.columns == docs.columns
