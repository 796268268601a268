"""Files in and out: geometry documents, indexes, job records, payloads, scores."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from neume.operators import payload, tokens
from neume.sources import files, musicxml, recognizers, symbol_text
from neume.streaming import jobs


def test_geometry_documents(spark, tmp_path):
    good = {"coordinate_space": "page_processed_image", "image": {"width": 420, "height": 220}, "systems": [{"index": 1, "bbox": [20, 70, 400, 150]}, {"index": 2, "bbox": [1, 2, 3]}], "barlines": [{"bbox": [31, 70, 33, 150], "center": [32, 110]}, {"bbox": None}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{ not json")
    docs = files.geometry(spark, str(tmp_path)).cache()
    assert docs.count() == 2 and docs.where("_corrupt_record is not null").count() == 1
    assert tokens.valid_systems(files.geometry_systems(docs)).count() == 1 and files.geometry_barlines(docs).count() == 1


def test_images_and_index(spark, tmp_path):
    for name in ("a.png", "b_debug.png", "sub/c.JPEG", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rpartition("/")[2] for r in files.images(spark, str(tmp_path)).collect()] == ["a.png", "c.JPEG"]
    (tmp_path / "index.csv").write_text("a.png,a.tokens\nb.png,nosymbols\nc.png,c.tokens\n")
    listing = spark.createDataFrame([("a.tokens",)], "path string")
    assert [r.image for r in files.missing_files(files.dataset_index(spark, str(tmp_path / "index.csv")), listing).collect()] == ["c.png"]


def test_cache(spark):
    inputs = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    cache = inputs.limit(1).select(F.sha2("content", 256).alias("hash"), F.lit("v1").alias("version"), F.lit("r").alias("result"))
    assert [d.count() for d in files.cached(inputs, cache, "v1")] == [1, 1] and files.cached(inputs, cache, "v2")[1].count() == 2


def test_jobs(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"job_id": "1", "status": "processing", "progress": 5}')
    (tmp_path / "2.json").write_text("broken")
    assert [r.job_id for r in files.job_records(spark, str(tmp_path)).collect()] == ["1"]
    recs = spark.createDataFrame([("1", 1, "queued", "u", None), ("1", 2, "failed", None, "e")], "job_id string, at int, status string, callback_url string, error string")
    one = jobs.merged_records(recs, "job_id", "at")
    assert one.first().asDict() == {"job_id": "1", "status": "failed", "callback_url": "u", "error": "e", "at": 2}
    assert json.loads(jobs.callback_payload(one).first().payload) == {"job_id": "1", "status": "failed", "callback_url": "u", "error": "e", "at": 2}
    assert spark.range(1).select(jobs.scaled(F.lit(50), 60, 80).alias("p")).first().p == 70


def test_public_json_leaves_nulls_out(spark):
    df = spark.createDataFrame([("d", (1, None))], "doc_id string, page struct<a:int,b:string>")
    assert payload.to_json(df).first().json == '{"a":1}' and payload.to_json(df, public=False).first().json == '{"a":1,"b":null}'


def test_repeat_rows_for_readers(spark):
    m = spark.createDataFrame([("d", 1, ["C", "F"], None), ("d", 2, ["C", "F"], 1)], "doc_id string, index int, chords array<string>, source_index int")
    assert sorted((r["index"], r.position, r.text, r.repeats) for r in payload.public_chords(m).collect()) == [(1, 0, "C", None), (1, 1, "F", None), (2, 0, "%", 1)]


def test_recognizer_that_fails(spark):
    def setup():
        def engine(images, allowed):
            if images[0] == b"bad":
                raise ValueError("broken page")
            return [[("C7", 0.0, 0.0, 1.0, 1.0, 0.9)]]

        return engine

    crops = spark.createDataFrame([("a", "r", b"good", "ABC"), ("b", "r", b"bad", "ABC")], "doc_id string, region string, content binary, allowed string")
    got = {r.doc_id: (r.text, r.error) for r in recognizers.recognize(crops, setup).collect()}
    assert got == {"a": ("C7", None), "b": (None, "broken page")}
    assert recognizers.recognize(crops, recognizers.blank).count() == 0


def test_scores(spark):
    twice = '<score-partwise><part id="P1"><measure number="1"><attributes><clef><sign>G</sign><line>2</line></clef></attributes></measure><measure number="2"><attributes><clef><sign>F</sign><line>4</line></clef></attributes></measure></part></score-partwise>'
    assert musicxml.without_later_clefs(twice).count("<clef") == 1
    both = twice.replace("<attributes><clef>", "<attributes><staves>2</staves><clef>")
    assert musicxml.without_later_clefs(both).count("<clef") == 2
    ended = musicxml.with_endings(twice, [(1, "1", "2")])
    assert ended.count("<ending") == 2 and musicxml.with_endings(ended, [(1, "1", "2")]) == ended
    broken = spark.createDataFrame([("x", "<score"), ("y", twice)], "doc_id string, xml string")
    assert {r.doc_id for r in musicxml.read_measures(broken).collect()} == {"y"}
    assert symbol_text.read_kern(spark.createDataFrame([("x", "**kern\n4zz\n")], "doc_id string, text string")).count() == 0
