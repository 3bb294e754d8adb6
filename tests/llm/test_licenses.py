"""Canonical forms, whole-text and line matches, and the SQL of the license scan."""

import textwrap
from pathlib import Path

import pytest

import oracle
from cantorium.llm import licenses, queries

COMMON = Path("/usr/share/common-licenses")
MIT = next(t for n, t in licenses.KNOWN if n == "MIT")


def test_variants_of_a_text_match_and_parts_do_not(spark):
    noisy = "Copyright (c) 2020 Some Body\n\n" + MIT.upper().replace("LICENSE", "LICENCE").replace(",", " , ").replace("\n", "\n\n  * ") + "\n(c) 2021 Others"
    rows = [
        (1, MIT), (2, noisy), (3, MIT[:-40]), (4, "some words\nReleased under the MIT licence\nmore"), (5, "he released under the MIT License. today"),
        (6, None), (7, ""), (8, "?!"), (None, MIT), (1, MIT), (9, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (10, "x " * 50000),
    ]
    docs = spark.createDataFrame([(i, t, "l", "n") for i, t in rows], "doc_id long, text string, licence string, line string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].licence for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == ["MIT", "MIT", None, None, None, None, None, None, "MIT"]
    assert by[1].text_digest == by[2].text_digest and by[6].text_digest is None and by[8].text_digest is None
    assert (by[4].notices, by[4].n_notices) == ("MIT", 1) and by[5].notices == "" and by[9].notices == "CC-BY-NC-4.0,MIT"
    assert licenses.scan(docs.limit(0)).collect() == []


def wrapped(text, width):
    return "\n".join(textwrap.fill(line, width) for line in text.split("\n"))


def test_whole_licences_are_found_however_they_are_wrapped(spark):
    years = "Copyright (c) 2019-2024, Some Body and others. All rights reserved.\n\n"
    texts = [(name, text) for name, text in licenses.KNOWN if "\n" in text]
    rows = [(name, wrapped(text, width)) for name, text in texts for width in (30, 47, 72, 10_000)]
    rows += [(name, f"{heading}\n\n{years}{wrapped(text, 61)}") for name, text in texts for heading in licenses.HEADINGS[name]]
    rows += [("MIT", "Copyright 2020 X. " + MIT.replace("\n", " ")), ("MIT", wrapped(MIT.replace("sublicense", "sub license"), 33)), ("MIT", MIT.replace("sublicense", "sub\nlicense"))]
    rows += [(None, "before\n" + MIT), (None, MIT + "\nafter"), (None, "x\n" * 20_000)]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


def test_a_notice_after_a_copyright_statement(spark):
    text = "Copyright (c) 2020 X. Licensed under the MIT License.\n© Y, all rights reserved\nwords"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.notices == "MIT" and row.licence is None


@pytest.mark.skipif(not COMMON.exists(), reason="no licence texts on this machine")
def test_long_licences_by_their_digests(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(name, (COMMON / file).read_text()) for file, name in names.items()]
    rows = texts + [(name, text.upper().replace("\n", "\r\n # ")) for name, text in texts] + [(None, text[:-30]) for _, text in texts]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


def test_sql(spark):
    oracle.same(spark, queries.QUERIES["op3_license_digests"], queries.ORACLES["op3_license_digests"], "/root/testdata/sf0.001")
