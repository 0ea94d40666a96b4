import textwrap

from sieveline.llm.license_scan import TEMPLATES, scan_licenses, telling_features

LONG = [(f, t) for f, ts in TEMPLATES.items() for t in ts if len(t) > 150]


def test_wrapped_templates_are_named_at_their_first_line(documents):
    rows = []
    for width in (40, 72):
        for _, t in LONG:
            rows.append((len(rows), "A first paragraph.\r\nOf two lines.\r\n\r\n \r\n" + "\r\n".join(textwrap.wrap(t, width)) + "\r\n\r\nThe last one."))
    got = {r.doc_id: (r.family, r.paragraph) for r in scan_licenses(documents(rows)).collect() if r.family != "unknown"}
    assert {i: f for i, (f, _) in got.items()} == {i: LONG[i % len(LONG)][0] for i in range(len(rows))}
    # the long Apache text holds the short one, which names a line of its own
    assert all(p == 5 or f == "apache" for f, p in got.values())


def test_wrapped_text_beside_a_named_line(documents):
    mit = next(t for f, t in LONG if f == "mit")
    rows = [(1, "Licensed under CC BY-NC 4.0.\n" + "\n".join(textwrap.wrap(mit, 72)) + "\nReleased into the public domain; no copyright is claimed.")]
    got = [(r.paragraph, r.family) for r in scan_licenses(documents(rows)).orderBy("paragraph").collect()]
    assert got == [(1, "cc-by-nc"), (2, "mit"), (2 + len(textwrap.wrap(mit, 72)), "public-domain")]


def test_statements_without_an_anchor(documents):
    texts = ["Distributed under the GNU GPL v3", "CC BY-SA 4.0", "the software is provided as is, without warranty of any kind", "given under the GNU\nGPL and\nthat is all", "without\nwarranty"]
    rows = scan_licenses(documents(list(enumerate(texts)))).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    assert {r.doc_id: r.family for r in rows}[1] == "cc-by-sa"
    assert {(r.paragraph, r.family) for r in rows if r.doc_id == 4} == {(1, "unknown")}


def test_ordinary_texts_give_no_rows(documents):
    assert {"gnu", "cc by", "without warranty"} <= set(telling_features())
    texts = ["this work is provided as is, all of it", "wir gehen mit dem Hund", "a creative use of the source code", "version 2.0 of the 3 parts"]
    assert scan_licenses(documents(list(enumerate(texts)))).count() == 0
