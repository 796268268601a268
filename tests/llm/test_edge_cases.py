"""Every operator and stage over nulls, empty, blank and very long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from neume.llm import decontam, language, licenses, line_dedup, mixing, near_dedup, pii, quality, toxicity
from tests.llm.conftest import prose

N = 37


def _labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 25)] + [(None, 1, 1), (2, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


def _items(spark, odd_docs):
    text = odd_docs.where("doc_id = 9").first().text
    return spark.createDataFrame([(1, " ".join(text.split()[5:40])), (2, None), (3, ""), (4, "one two"), (None, " ".join(text.split()[20:55])), (1, " ".join(text.split()[5:40]))], "item_id long, text string")


def test_line_dedup(spark, odd_docs, no_docs):
    shared = odd_docs.withColumn("text", F.when(F.col("doc_id") <= 24, F.concat("text", F.lit("\nRead  more about us."))).otherwise(F.col("text")))
    out = line_dedup.without_boilerplate(shared)
    assert out.columns == [*shared.columns, "lines_removed"] and out.count() == N
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert got[3].lines_removed == 1 and not got[3].text.endswith("us.") and got[3].n_chars == len(got[3].text)
    assert got[30].text is None and got[31].text == "" and got[51].text == "x" * 300_000
    assert line_dedup.without_boilerplate(no_docs).count() == 0


def test_line_dedup_near_threshold(spark):
    rows = [(i, f"own {i} words here\nshared line", f"s{i % k}") for k in (9, 10, 11) for i in range(k * 100, k * 100 + 3 * k)]
    for k, removed in ((9, 0), (10, 30), (11, 33)):
        df = spark.createDataFrame([r for r in rows if r[0] // 100 == k], "doc_id long, text string, source string")
        assert line_dedup.without_boilerplate(df).agg(F.sum("lines_removed")).first()[0] == removed


def test_line_dedup_leaves_copies_whole(spark):
    df = spark.createDataFrame([(i, "all of this\nis a copy", f"s{i}") for i in range(20)], "doc_id long, text string, source string")
    assert line_dedup.without_boilerplate(df).where("lines_removed > 0").count() == 0


def test_line_dedup_cleans_short_pages(spark):
    """Shared lines of most of the characters go too where a page has a line of its own, here and in the pipeline."""
    shared = " ".join(["every word of this passage stands on many sites"] * 7)
    rows = [(i, f"own words {i}\n{shared}\n ", f"s{i}") for i in range(12)] + [(20, f"{shared}\n \u00a0\t", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.without_boilerplate(df).collect()}
    assert got == {i: (f"own words {i}\n ", 1) for i in range(12)} | {20: (rows[-1][1], 0)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == {i: t for i, (t, _) in got.items()}


def test_toxicity(spark, odd_docs, no_docs):
    model = toxicity.learn(odd_docs, _labels(spark))
    out = toxicity.toxicity(odd_docs, model).collect()
    assert len(out) == N and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.score for r in out if r.doc_id in (30, 31)} == {next(r.score for r in out if r.doc_id == 32)}
    assert toxicity.toxicity(no_docs, model).count() == 0
    nothing = toxicity.learn(no_docs, _labels(spark).limit(0))
    assert {r.score for r in toxicity.toxicity(odd_docs, nothing).collect()} == {0.0}
    assert toxicity.without_toxic(odd_docs, nothing).count() == N


def test_licenses(odd_docs, no_docs):
    out = licenses.scan(odd_docs.withColumn("text", F.when(F.col("doc_id") == 3, "x.\nReleased under  the MIT license.\ny").otherwise(F.col("text"))))
    got = {r.doc_id: r.licenses for r in out.collect()}
    assert got[3] == "MIT" and got[30] == "" and got[31] == "" and got[50] == "" and out.count() == N
    assert licenses.scan(no_docs).count() == 0


GPL3 = """    frob - does things
    Copyright (C) 2020  A. Name

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
ZLIB = """Copyright (c) 2020 A. Name

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment would be appreciated."""


def test_wrapped_notices(spark):
    notices = {"GPL-3.0-or-later": GPL3, "MPL-2.0": MPL, "Zlib": ZLIB}
    notices["GPL-2.0-or-later"] = GPL3.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
    notices["AGPL-3.0-or-later"] = GPL3.replace("GNU General", "GNU Affero General")
    notices["LGPL-2.1-or-later"] = notices["GPL-2.0-or-later"].replace("GNU General", "GNU Lesser General").replace("program", "library").replace("version 2", "version 2.1")
    rows = [(name, form(t)) for name, t in notices.items() for form in (str, lambda x: " ".join(x.split()).replace("A. Name ", "A. Name. "), lambda x: x.replace("\n", "\r\n# "))]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.licenses) for r in out] == [(name, name) for name, _ in rows]
    assert all("gpl-free gpl-hope gpl-received" in r.sentences for r in out if r.doc_id == "GPL-3.0-or-later")


def test_decontamination(spark, odd_docs, no_docs):
    items = _items(spark, odd_docs)
    hits = decontam.contaminated(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(9, 1), (9, None), (41, 4), (42, 4)}
    left = decontam.without_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == N - 3
    assert decontam.contaminated(no_docs, items).count() == 0 and decontam.contaminated(odd_docs, items.limit(0)).count() == 0


def test_quality(odd_docs, no_docs):
    rows = quality.ledger(odd_docs)
    got = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == N and got[30].n_words == got[31].n_words == got[32].n_words == 0 and got[50].n_repeat_words == got[50].n_words
    kept = rows.where(quality.passes(3)).count()
    table = {r.rule: r for r in quality.ablation(rows).collect()}
    assert all(r.kept >= kept and r.only_this == r.kept - kept for r in table.values())
    assert quality.ledger(no_docs).count() == 0 and quality.ablation(quality.ledger(no_docs)).count() == 0


def test_personal_data(odd_docs, no_docs):
    out = pii.scan(odd_docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == N and got[30].spans == got[31].spans == "" and got[30].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.scan(no_docs).count() == 0


def test_mixing(odd_docs, no_docs):
    out = mixing.mix(odd_docs).collect()
    assert len(out) == N and all(0 <= r.taken <= 2 * r.size for r in out)
    by: dict[float, list] = {}
    for r in out:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert {r.taken for r in out if r.doc_id in (30, 31, 32)} == {0}
    assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(r.size for r in out), abs=13)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(odd_docs).collect()), key=str)
    assert mixing.mix(no_docs).count() == 0


def test_near_dedup(odd_docs, no_docs):
    out = near_dedup.near_duplicates(odd_docs).collect()
    assert len(out) == N
    got = {r.doc_id: r for r in out}
    assert got[40].component_id == 7 and not got[40].kept and got[7].kept
    assert got[42].component_id == 41 and got[41].n_shingles == 1
    assert got[30].n_shingles == got[31].n_shingles == got[32].n_shingles == 0 and got[30].kept and got[31].component_id == 31
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_language(odd_docs, no_docs):
    model = language.learn(odd_docs)
    out = language.label_documents(odd_docs, model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == N and set(model[0]) == {"en", "fr"}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (30, 31, 32)) and got[51].lang_pred in ("en", "fr")
    assert language.label_documents(no_docs, model).count() == 0
    assert {r.lang_pred for r in language.label_documents(odd_docs, language.learn(no_docs)).collect()} == {"und"}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, odd_docs, no_docs, empty, tmp_path):
    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    _items(spark, odd_docs).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = no_docs if empty else odd_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns, name
        rows = out.collect()
        assert not empty or not rows
        docs = spark.createDataFrame(rows, out.schema)


def test_pipeline_keeps_one_row_of_an_id(spark):
    rows = [(1, prose(1, 40)), (1, prose(1, 40)), (2, prose(1, 40)), (3, prose(3, 40)), (None, prose(4, 40)), (None, prose(4, 40)), (5, None), (5, ""), (6, prose(6, 40)), (6, prose(7, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"no_text": F.lit(1), "count": F.lit(2), "r": F.lit(3)})
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, rows[0][1]), (3, rows[3][1]), (0, rows[4][1]), (0, rows[4][1]), (5, ""), (6, min(rows[8][1], rows[9][1]))])
