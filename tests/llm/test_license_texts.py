"""License texts and wordings beyond those of the corpus."""

from tidewell.llm.licenses import TEMPLATES, license_scan

from .conftest import words

USUAL = [
    ("MIT-notice-1-text", "This project is licensed under the MIT License"),
    ("LGPL-2.1-text", TEMPLATES.get("LGPL-2.1-text", "")), ("AGPL-3.0-text", TEMPLATES.get("AGPL-3.0-text", "")),
    ("GPL-2.0-text", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0-text", "/* This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("ISC-text", TEMPLATES.get("ISC-text", "")), ("EPL-2.0-text", TEMPLATES.get("EPL-2.0-text", "")), ("CC0-1.0-text", TEMPLATES.get("CC0-1.0-text", "")),
    ("CC-BY-SA-4.0-text", TEMPLATES.get("CC-BY-SA-4.0-text", "")), ("Unlicense-text", TEMPLATES.get("Unlicense-text", "")),
    ("CC-BY-4.0-notice-1-text", "Text is licensed under CC BY 4.0 unless noted"),
]


def test_usual_texts_and_repeats(spark):
    rows = [(k, f"{words(90 + k, k)} {text} {words(60, 50 + k)}") for k, (_, text) in enumerate(USUAL)]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan(spark.createDataFrame(rows * 1, "doc_id long, text string")).collect()}
    assert [got.get((k, name)) for k, (name, _) in enumerate(USUAL)] == [1.0] * len(USUAL)
    again = license_scan(spark.createDataFrame([rows[1]] * 3 + [rows[0]], "doc_id long, text string")).collect()
    counts = [sum(r["doc_id"] == k and r["license"] == USUAL[k][0] for r in again) for k in (0, 1)]
    assert counts == [1, 3]


def test_every_template_finds_itself(spark):
    names = sorted(TEMPLATES)
    docs = spark.createDataFrame([(k, f"{words(40, k)} {TEMPLATES[x]} {words(30, k + 99)}") for k, x in enumerate(names)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in license_scan(docs).collect()}
    assert {(k, x) for k, x in enumerate(names)} <= got
