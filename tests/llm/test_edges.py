"""Every operator on odd rows and on an empty table."""

import pytest
from pyspark.sql import functions as F

from loamline.llm import chunk_dedup, exact_dedup, minhash, mixing, mpegts, packing, quality, site_style, toxicity, warc

LABELS = "doc_id long, quality int, toxic int, extra string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (3, 0, 1, "x"), (4, 0, None, "x"), (5, 1, 0, None), (6, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (7, 0, 1, "y")], LABELS)


RUNS = {
    "op1": lambda d, labels: quality.quality_scores(d, labels),
    "op2": lambda d, labels: exact_dedup.exact_groups(d),
    "op3": lambda d, labels: toxicity.toxicity_scores(d, labels),
    "op4": lambda d, labels: mixing.mix_sources(d),
    "op5": lambda d, labels: packing.pack(d),
    "op6": lambda d, labels: mpegts.demux_streams(mpegts.mux_documents(d)),
    "op9": lambda d, labels: minhash.near_duplicates(d),
    "op10": lambda d, labels: chunk_dedup.repeated_spans(d),
    "good": lambda d, labels: quality.good_documents(d, labels),
    "copies": lambda d, labels: exact_dedup.drop_exact_copies(d),
    "near": lambda d, labels: minhash.drop_near_duplicates(d),
    "mixed": lambda d, labels: mixing.sampled_documents(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty(spark, empty, labels, name):
    assert RUNS[name](empty, labels).count() == 0
    assert RUNS[name](empty, labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_odd(odd, labels, name):
    out = RUNS[name](odd, labels).collect()
    if name in ("op1", "op2", "op3", "op4", "op6", "op9"):
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in odd.collect())
    if name in ("good", "copies", "near", "mixed"):  # the caller's columns come back as they were, whatever they are called
        assert RUNS[name](odd, labels).columns == odd.columns and {tuple(r) for r in out} <= {tuple(r) for r in odd.collect()}
    if name == "op5":
        assert {r["doc_id"] for r in out} == {r["doc_id"] for r in odd.collect()} and sum(r["start"] == 0 for r in out) == odd.count()
    if name == "op10":
        assert out == []  # no two documents share 50 words


def test_cut_texts_keep_clashing_columns(odd):
    passage = " ".join(f"w{i}" for i in range(90))
    docs = odd.withColumn("text", F.concat(F.col("text"), F.lit(" " + passage)))
    left = chunk_dedup.without_repeats(docs, chunk_dedup.repeated_spans(docs))
    assert left.columns == odd.columns and left.drop("text").exceptAll(odd.drop("text")).count() == 0 and left.count() == odd.count()
    assert max(left.where("text is not null").select(F.length("text")).collect())[0] >= 300_000


def test_no_labels_is_neutral(odd, labels):
    assert {r["score"] for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect())


def test_exact_groups(odd):
    out = exact_dedup.exact_groups(odd).collect()
    by = {}
    for r in out:
        by.setdefault(r["text_sha256"], []).append(r)
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
    fox = next(g for g in by.values() if len(g) == 4)
    assert {r["keep_id"] for r in fox} == {5}
    empties = next(g for g in by.values() if {r["doc_id"] for r in g} == {2, 3})
    assert {r["keep_id"] for r in empties} == {3}
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns and left.count() == len(by)


def test_index_persists(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], "doc_id long, text string")
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    exact_dedup.exact_groups(first, index).collect()
    index.close()
    again = exact_dedup.DigestIndex(spark, path, buckets=4)  # a new session would name the same files
    out = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup.exact_groups(later, again).collect()}
    assert out == {9: (1, False, 2), 8: (8, True, 2), 7: (8, False, 2)} and again.rows().count() == 3
    fresh = first.select(F.col("text").cast("binary").alias(exact_dedup.DIGEST)).join(spark.table(again.table).select(exact_dedup.DIGEST).hint("merge"), exact_dedup.DIGEST, "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1
    again.close()


def test_index_takes_a_batch_twice(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    run = lambda index, batch=None: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, index, batch).collect())
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    once = [(1, 1, 1, True), (2, 3, 2, False), (3, 3, 2, True)]
    assert run(index, "monday") == once
    assert run(index, "monday") == once  # the same batch after a failure: the same answer
    assert run(index, "tuesday") == [(1, 1, 2, False), (2, 3, 4, False), (3, 3, 4, False)]  # the same rows as another batch: all known
    assert run(index, "tuesday") == [(1, 1, 2, False), (2, 3, 4, False), (3, 3, 4, False)]
    index.close()


def test_hot_text_of_an_old_batch(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    exact_dedup.exact_groups(spark.createDataFrame([(1, "a")], "doc_id long, text string"), index).collect()
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    out = exact_dedup.exact_groups(many, index).collect()
    assert {(r["keep_id"], r["group_size"], r["kept"]) for r in out} == {(1, 1001, False)} and len(out) == 1000
    index.close()


def test_no_table_is_left(spark, odd):
    exact_dedup.exact_groups(odd).collect()
    exact_dedup.drop_exact_copies(odd).collect()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_")] == []


def test_near_nulls(odd):
    out = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()}
    assert out[2, 0] == (2, True) and out[3, 0] == (3, True) and out[10, 0] == (10, True)
    assert out[6, 1] == (6, True) and out[7, 1] == (7, True)
    assert {v[0] for k, v in out.items() if k[0] in (1, 5, 8) and k[1] > 1} == {None}  # the row without an id has the same words and is smallest


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.x/1", "<article><p>one</p></article>", 0), (2, None, None, 1), (3, "http://a.x/1", "", 2), (None, "u", "<p>one", 3), (4, "http://b", "<p>" + "é" * 90_000, 4), (5, "http://c", "<p>" + "é" * 90_000, 4), (5, "http://c", "<p>" + "é" * 90_000, 4)],
        "page_id long, url string, html string, text int",
    )
    out = {(r["page_id"], r["text"][:5]): r["n_chars"] for r in site_style.extract(pages).collect()}
    assert out == {(1, "one"): 3, (2, ""): 0, (3, ""): 0, (None, "one"): 3, (4, "ééééé"): 90_000, (5, "ééééé"): 90_000}
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived_pages(pages, segment=4096).collect())
    big = 180_003
    assert got == [("1", 29, "response", None), ("2", 0, "response", None), ("3", 0, "revisit", 2), ("4", big, "response", None), ("5", big, "revisit", 4), ("5", big, "revisit", 4), ("None", 6, "response", None)]
    assert site_style.extract(pages.limit(0)).count() == 0 and warc.archived_pages(pages.limit(0)).count() == 0


def test_mixed_targets(odd):
    out = mixing.mix_sources(odd).collect()
    total = sum(r["size"] for r in out)
    assert sum(r["taken"] for r in out) == pytest.approx(total, abs=4)
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.sampled_documents(odd).columns == odd.columns


def test_buckets_are_even_whatever_the_weights(spark):
    rows = spark.range(60_000).select(F.lit("sx").alias("name"), F.lit(60_000).alias("rows"), F.greatest(F.lit(1e-18), -F.log(F.rand(3)) / F.when(F.col("id") % 3 == 0, 0.05).when(F.col("id") % 3 == 1, 0.11).otherwise(0.9)).alias("key"))
    held = mixing.bucketed(rows).groupBy("cell", "part").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("cell", "part").collect()
    assert sum(r["n"] for r in held) == 60_000 and max(r["n"] for r in held) < 3 * mixing.ROWS_A_BUCKET
    assert all(a["high"] <= b["low"] for a, b in zip(held, held[1:], strict=False))


def test_weights_may_come_from_the_classifier(spark, labels, odd):
    import numpy as np

    weigh = lambda texts: np.array([0.9 if t and "fox" in t else 0.0 for t in texts.to_pylist()])
    got = {r["doc_id"]: r["weight"] for r in mixing.measured(odd, weigh).collect()}
    assert got[1] == 0.9 and got[3] == mixing.LEAST_WEIGHT
    model = quality.train(odd, labels)
    assert len(mixing.sampled_documents(odd, quality.weigher(model)).columns) == len(odd.columns)


def test_spans_ignore_words_of_one_document(spark):
    passage = " ".join(f"unique{i * 37 % 101}word" for i in range(70))
    docs = spark.createDataFrame([(1, "alpha beta gamma. " + passage), (2, "other words stand here first, " + passage + " and after"), (3, passage[:120] * 2), (4, None)], "doc_id long, text string")
    spans = chunk_dedup.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in spans} == {1, 2} and {r["first_doc_id"] for r in spans} == {1}
    left = {r["doc_id"]: r["text"] for r in chunk_dedup.without_repeats(docs, chunk_dedup.repeated_spans(docs)).collect()}
    assert left[1].endswith(passage) and len(left[2]) < 250 and left[3] == passage[:120] * 2 and left[4] is None


def test_held_out_matches_crc32(spark):
    import zlib

    out = spark.range(50).select("id", quality.held_out("id", 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in out)
    assert spark.range(1).select(F.lit(None).cast("long").alias("id")).select(quality.held_out("id", 4, 2).alias("h")).first()["h"] in (True, False)
