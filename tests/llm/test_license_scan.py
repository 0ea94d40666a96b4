import math
import re

from pyspark.sql import functions as F

from sieveline.llm.license_scan import CONFIRM, TEMPLATES, gate_pattern, grams_of, scan_licenses, train


def plain(line):
    low = line.lower()
    if not re.search(gate_pattern(), low):
        return None
    model, grams = train(), grams_of(line)
    z = list(model.bias)
    for g in grams:
        if g in model.weights:
            z = [a + b for a, b in zip(z, model.weights[g], strict=True)]
    best = max(range(len(z)), key=lambda i: (z[i], -i))
    p = 1 / sum(math.exp(v - z[best]) for v in z)
    overlap = max((len(set(grams) & set(grams_of(t))) / len(grams_of(t)) for t in TEMPLATES.get(model.families[best], ())), default=0.0)
    return (model.families[best] if p >= model.threshold and overlap >= CONFIRM else "unknown"), p, overlap


def test_every_template_has_an_anchor_and_is_named(spark, documents):
    rows, want = [], {}
    for f, texts in TEMPLATES.items():
        for t in texts:
            assert re.search(gate_pattern(), t.lower())
            want[len(rows)] = f
            rows.append((len(rows), f"Some first line.\n{t}\nand a last line"))
    got = {r.doc_id: (r.family, r.paragraph) for r in scan_licenses(documents(rows)).collect()}
    assert got == {i: (f, 2) for i, f in want.items()}


LINES = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!!",
    "the driving license office is closed", "her licence to teach was renewed in may", "copyright", "licensed", "A story without any of it.",
    "Released under the MIT Licence? no: released under the BSD 3-Clause License", "unlicensed copy under version 2.0 of the public domain",
]


def test_native_scores_equal_the_plain_model(spark, documents, awkward):
    docs = documents([(i, t) for i, t in enumerate(LINES)] + [(50, "\r\n".join(LINES)), (51, " ".join(["word"] * 5000) + "\n" + LINES[1]), (51, " ".join(["word"] * 5000) + "\n" + LINES[1])]).union(awkward)
    rows = scan_licenses(docs.withColumn("family", F.lit(1)).withColumn("paragraph", F.lit("x"))).collect()
    got = sorted((r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.overlap, 6)) for r in rows)
    want = []
    for r in docs.collect():
        for k, line in enumerate((r.text or "").replace("\r\n", "\n").split("\n")):
            if x := plain(line):
                want.append((r.doc_id, k + 1, x[0], round(x[1], 6), round(x[2], 6)))
    assert got == sorted(want)
    family = {r.doc_id: r.family for r in rows if r.doc_id < 10}
    assert family[0] == "gpl" and family[1] == "cc-by-nc" and family[2] == "apache"
    assert family[3] == family[4] == family[5] == family[6] == "unknown" and 7 not in family


def test_empty_table(documents):
    assert scan_licenses(documents([])).count() == 0


def test_planted_lines_of_the_tables_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {"General Public License": "gpl", "CC BY-NC": "cc-by-nc", "MIT License": "mit", "Apache License": "apache"}
    found = {(r.doc_id, r.family) for r in scan_licenses(docs).collect()}
    for r in docs.collect():
        for words, family in planted.items():
            assert (words in r.text) == ((r.doc_id, family) in found)


def test_short_statements_and_versions(documents):
    texts = {
        "SPDX-License-Identifier: GPL-2.0-only": "gpl", "SPDX-License-Identifier: LGPL-3.0-or-later": "lgpl", "SPDX-License-Identifier: CC0-1.0": "public-domain", "This code is GPLv3.": "gpl",
        "Released under Apache 2.0": "apache", "CC BY 4.0": "cc-by", "Lizenziert unter der MIT-Lizenz": "mit", "Distributed under the GNU GPL v3": "gpl", "SPDX-License-Identifier: ISC": "unknown",
        "This work is licensed under the GNU General Public License, version 2.": "gpl", "The driver must hold a valid licence.": "unknown",
    }
    got = {r.doc_id: r.family for r in scan_licenses(documents(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(texts.values()))
    assert scan_licenses(documents([(1, "wir gehen der mit dem Hund, unter der Bruecke")])).count() == 0
