"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import chat, fingerprints, lattice, lines, mixing, neardup, outliers, packing, sharding, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "a b c d e f " * 30, "en", "s", 3), (1, "a b c d e f " * 30, "en", "s", 3), (None, "x y", None, None, None), (2, None, "en", None, None),
        (3, "", None, "s", 0), (3, "other text", "en", "s", 0), (4, "word " * 30_000, "en", "s", 1), (5, "é\n\n \t" * 9, "fr", "é", 5), (6, "y" * 5000, "", "", 6),
        (7, None, None, None, None), (7, None, None, None, None)]
CLASHES = ["row", "site", "size", "hash", "part", "k1", "k2", "node", "keys", "word", "words", "w", "n", "lines", "kept", "uid", "length", "shard", "g", "x0",
           "h", "t", "at", "base", "extra", "copies", "range", "guest", "starts", "learns", "n_words", "base_failed", "target"]

TABLES = {"fingerprints": fingerprints.fingerprint_edits, "plain fingerprints": fingerprints.fingerprint, "substrings": substrings.remove_repeats,
          "classes": neardup.class_table, "mix": mixing.mix_table, "scores": lattice.score, "quality": outliers.quality_table, "shards": sharding.shard_table}


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", TABLES)
def test_a_row_for_every_row(spark, odd, name):
    plain = sorted(map(repr, TABLES[name](odd).collect()))
    assert len(plain) == len(ROWS)
    assert sorted(map(repr, TABLES[name](clashing(odd)).collect())) == plain
    empty = TABLES[name](odd.where("false"))
    assert empty.collect() == [] and empty.columns == TABLES[name](odd).columns


def test_packing(spark, odd):
    rows = packing.pack(clashing(odd)).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    assert sum(r["length"] == 1 for r in rows) == 4  # texts that are NULL or empty
    assert packing.pack(odd.where("false")).collect() == []


def test_chat(spark):
    rows = [(None, 0, "u", "a"), (1, None, None, None), (1, None, None, None), (1, 0, "u", ""), (2, 0, "u", "x" * 200_000), (3, 0, "u", "a"), (3, 0, "u", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.render(clashing(turns.withColumn("k", F.lit(1)))).collect()
    assert sorted((str(r["conv_id"]), r["position"]) for r in got) == [("1", 1), ("1", 2), ("2", 1), ("3", 1), ("3", 2)]
    assert chat.render(turns.where("false")).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (None, "http://h/x", "<p>a</p>"), (2, "no url", ""), (2, "no url", "")] + [(k, "HTTP://H:80/y", f"<p>menu</p><b>{k}</b>") for k in range(5, 12)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = lines.digest(lines.clean_pages(pages)).collect()
    assert len(got) == len(rows)
    assert all((r["n_lines"], r["n_removed"]) == (2, 1) for r in got if r["page_id"] and r["page_id"] >= 5)
    assert lines.clean_pages(pages.where("false")).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, odd, name, stage):
    docs = clashing(odd)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert all(r["word"] == "own word" for r in rows)
    assert stage(spark, docs.where("false"), "").collect() == []
    if name == "line dedup":
        assert len(rows) == len(ROWS)


def test_near_dedup_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(i, f"t{i % 3} " + "a b c d e f g", "en", "s", 1) for i in range(9)] + [(4, "t1 a b c d e f g", "en", "s", 1)] * 2, SCHEMA)
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == [0, 1, 2]


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
