"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing names: for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.llm import balltree, content, mixing, ngram_join, packing, permutation, pii, quality, repeats, wordpiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["node", "bands", "ref", "n_bytes", "mx_row", "q_row", "q_loss", "class_id", "length", "rank", "id", "size", "pk_rank", "a.b"]
LONG = "word " * 60_000
ROWS = [
    (1, "one two three four five six seven", "en", "s1", 33), (1, "one two three four five six seven", "en", "s1", 33), (2, "one two three four five six seven", "en", None, 33),
    (3, None, None, None, None), (None, None, "en", "s2", 0), (4, "", "fr", "s2", 0), (5, "   \n ", "fr", "s2", 5), (6, LONG, "en", "s1", len(LONG)), (7, "x" * 250_000, "en", "s3", 250_000), (8, "word", None, "s3", 4),
]


@pytest.fixture(params=["rows", "none"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS if request.param == "rows" else [], DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (6, 1, None), (8, None, None)], "doc_id long, quality int, toxic int").withColumn("id", F.lit(0))


OPERATORS = {
    "ngram_join": ngram_join.near_duplicates, "repeats": repeats.without_repeats, "packing": lambda d: packing.pack(d, 64), "mixing": mixing.mix_sources, "tokens": wordpiece.token_counts, "pii": pii.found,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_anything(docs, name):
    n, got = docs.count(), OPERATORS[name](docs).count()
    assert got >= n if name == "packing" else got == n


def test_quality_takes_anything(docs, labels):
    assert quality.judged(docs, labels).count() == docs.count()
    assert quality.judged(docs, labels.limit(0)).where("NOT q_keep").count() == 0


@pytest.mark.parametrize("stage", ["quality", "dedup", "pii", "mix"])
def test_stages_give_the_columns_of_documents(docs, labels, stage):
    run = {"quality": lambda d: quality.quality_stage(d, labels), "dedup": ngram_join.dedup_stage, "pii": pii.pii_stage, "mix": mixing.mix_stage}[stage]
    out = run(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    n, got = docs.count(), out.count()
    assert {"quality": got == n, "dedup": got == min(n, 6), "pii": got == n, "mix": got <= 2 * n}[stage], got


def test_defined_results_for_odd_texts(spark):
    d = spark.createDataFrame(ROWS, DOCS)
    tokens = {(r["doc_id"], r["n_tokens"]) for r in wordpiece.token_counts(d).collect()}
    assert {(3, 0), (4, 0), (5, 0), (None, 0)} <= tokens
    near = {r["doc_id"]: r for r in ngram_join.near_duplicates(d).collect()}
    assert near[2]["class_id"] == 1 and near[2]["n_copies"] == 2 and near[2]["n_links"] == 0
    assert near[3]["class_id"] == 3 and near[4]["class_id"] == 3  # empty texts are copies of each other
    gone = {r["doc_id"]: r for r in repeats.without_repeats(d).collect()}
    assert gone[6]["n_removed"] == gone[6]["n_bytes"] == len(LONG) and gone[7]["n_removed"] == 250_000 and gone[1]["n_removed"] == 0
    found = {r["doc_id"]: r for r in pii.found(d).collect()}
    assert found[3]["spans"] == "" and found[3]["n_email"] == 0
    assert packing.pack(d, 64).where("doc_id = 3").first()["length"] == 1


def test_pages_of_any_kind(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>> & <p"), (4, "u", "plain text"), (None, "u", "<p>" * 20_000 + "deep"), (5, "u", "<p>" + "word " * 200_000), (5, "u", "<script>never closed"), (6, "u", "<p a='>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in content.extract(df).collect()]
    assert len(got) == len(rows) and (1, "") in got and (4, "plain text") in got and (None, "deep") in got
    assert content.extract(df.limit(0)).count() == 0


VECTORS = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (100, [3.0e38, 1.0]), (200, [1.0, 0.0, 0.0]), (300, [])]


@pytest.mark.parametrize("search", [balltree.top_k, permutation.nearest])
def test_vectors_of_any_kind(spark, search):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "vec": F.lit(2), "rank": F.lit(3)})
    got = search(df, every=100, k=3).collect()
    first = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    ids = [i for _, i in first]
    assert 0 not in ids and not {3, 4, 5, 6, None} & {r["vec_id"] for r in got}
    assert ids == ([100, 1, 2] if search is balltree.top_k else [1, 2, 100])  # ties go to the smaller id
    assert not [r for r in got if r["query_id"] in (200, 300)]  # no other vector of these lengths
    assert search(df.limit(0)).count() == 0
