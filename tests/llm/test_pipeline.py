"""The pipeline's stages on a small corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
import quillon.llm.queries as queries


def test_stages_decide_and_keep_columns(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n=120: " ".join(rng.choice(words) for _ in range(n))
    good = [text() for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(100 + i, " | ".join(text().split()), "en", "s", 1) for i in range(40)]
    rows += [(200, good[0], "en", "s", 1), (201, good[1] + " password=hunter2222", "en", "s", 1), (202, None, None, None, None), (203, "", "en", "s", 0), (204, "12 34 " * 60, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        now = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert set(range(60)) <= kept[0] and not kept[0] & set(range(100, 140)) and not kept[0] & {202, 203}
    assert 204 not in kept[1] and set(range(60)) <= kept[1]
    assert kept[2] == set(range(60))
    assert kept[3] == kept[2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(range(60))


def test_registered():
    assert len(queries.queries()) == 14 and set(queries.oracle_sql()) <= set(queries.queries())


def test_near_duplicates_stage_with_repeated_and_null_ids(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    a, b, c, d = (" ".join(rng.choice(words) for _ in range(100)) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (2, a + " " + words[0], "x"), (None, c, "x"), (None, d, "x"), (3, c, "y"), (4, None, "z"), (4, None, "z"), (5, " \n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, a, "x"), (1, b, "x"), (None, d, "x"), (3, c, "y"), (4, None, "z"), (4, None, "z"), (5, " \n", "z")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.keep_one_of_each(spark, docs.limit(0), "").count() == 0


def test_language_stage_drops_latin_script_without_a_profile(spark):
    rng = random.Random(3)
    make = lambda words, n=80: " ".join(rng.choice(words) for _ in range(n))
    english = "the of and to in is that it was for on are with they be at this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    finnish = "ja on ei että se hän oli mutta kun niin minä sinä tämä mikä kuin myös vain jos sitten kaikki mitään olla tehdä sanoa tulla mennä nähdä yksi kaksi kolme hyvä suuri pieni uusi vanha päivä yö talo vesi maa ihminen lapsi äiti isä ystävä kaupunki metsä järvi kesä talvi syksy kevät aamulla illalla työssä koulussa kotona".split()
    texts = [make(english) for _ in range(60)] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(600)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "en" if i < 60 else None) for i, t in enumerate([*texts, *(make(finnish) for _ in range(10))])], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.keep_language(spark, docs, "").collect()} == set(range(60))


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    good = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "en", "mongo1", "x", "y", "z", "q", i) for i, t in enumerate([*good, good[0], None, "", "lorem " * 20_000])]
    names = "doc_id long, text string, lang string, _id string, _none string, _mark string, _language string, _quality_n_words string, `_near_id.x` long"
    docs = spark.createDataFrame(rows, names)
    docs = docs.withColumns({"_bitmap_at": F.lit("b"), "_near_mark": F.lit("m"), "_bitmap_word": F.lit(None).cast("string")})
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, str(tmp_path))
            assert got.columns == docs.columns, name
            kept = got.collect()
            assert all((r["_id"], r["_none"], r["_mark"], r["_language"], r["_quality_n_words"], r["_near_mark"], r["_bitmap_at"]) == ("mongo1", "x", "y", "z", "q", "m", "b") for r in kept), name
            assert all(r["_near_id.x"] == r.doc_id for r in kept) and (len(kept) >= 12) == (table is docs), name
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == set(range(16))
