"""Line dedup, license scan and quotation linking against plain definitions."""

import hashlib
import random
import re
from pathlib import Path

import pytest

from rxframe.llm import licenses, line_dedup, quotations

SPACE = " \t\n\x0b\x0c\r"


def deleted_lines(docs: dict, min_words: int) -> dict:
    """Lines inside a run of ``min_words`` words or more that also begins at an earlier line; by comparing all pairs."""
    places, lines = [], {}
    for k in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        own = [(i, x) for i, x in enumerate(docs[k].split("\n")) if x.strip(SPACE)]
        lines[k] = own
        places += [(k, j) for j in range(len(own))]
    gone = {k: set() for k in docs}
    for n, (k, j) in enumerate(places):
        for k2, j2 in places[:n]:
            run, words = 0, 0
            while j + run < len(lines[k]) and j2 + run < len(lines[k2]) and lines[k][j + run][1] == lines[k2][j2 + run][1]:
                words += len([w for w in re.split(f"[{SPACE}]", lines[k][j + run][1]) if w])
                run += 1
            if words >= min_words:
                gone[k] |= {lines[k][j + x][0] for x in range(run)}
    return gone


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_line_runs_match_all_pairs(spark, documents, min_words):
    r = random.Random(min_words)
    stock = ["a b", "c", "d e f", "g", "", "  ", "h i j k l m n", "o"]
    docs = {(i, 0): "\n".join(r.choice(stock) for _ in range(r.randrange(0, 14))) for i in range(30)}
    docs[(100, 0)] = docs[(101, 0)] = "\n".join(stock * 3)
    expected = deleted_lines(docs, min_words)
    found = line_dedup.dedup(documents([(k[0], t) for k, t in docs.items()]), min_words=min_words).collect()
    assert len(found) == len(docs)
    for row in found:
        k = (row.doc_id, 0)
        assert row.clean_text == "\n".join(x for i, x in enumerate(docs[k].split("\n")) if i not in expected[k])
        assert row.n_deleted == len(expected[k])
        assert row.n_lines == sum(bool(x.strip(SPACE)) for x in docs[k].split("\n"))
        assert row.kept == "x" and row.row == 1


def test_line_dedup_odd_rows(spark, documents):
    run = "one two three\nfour five six"
    rows = [(1, None), (2, ""), (3, run), (3, run), (None, run), (4, "x\n" + run + "\n\ny")]
    found = line_dedup.dedup(documents(rows), min_words=5).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.clean_text, r.n_deleted) for r in found} == {
        (1, None, 0), (2, "", 0), (3, run, 0), (None, "", 2), (4, "x\n\ny", 2)
    }
    assert line_dedup.dedup(documents(rows).limit(0)).count() == 0


def test_line_dedup_finds_long_lines(given):
    docs = given("documents")
    texts = {(r.doc_id, 0): r.text for r in docs.collect()}
    expected = deleted_lines(texts, 50)
    found = {(r.doc_id, 0): r.n_deleted for r in line_dedup.dedup(docs).collect()}
    assert found == {k: len(v) for k, v in expected.items()} and any(found.values())


def test_licenses(spark, documents):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    rows = [
        (1, "Copyright (c) 2020 A. Author\n\n" + mit.upper().replace(", ", ",\n   ")),
        (2, mit.replace("sublicense", "sub-license") + "\nAll rights reserved."),
        (3, mit + " And more."),
        (4, "Some prose.\n# Licenced under the Apache Licence, version 2.0\nMore prose on copyright."),
        (5, None), (6, "  \n"), (7, "(c) 2021 someone"), (8, "released under the MIT license"), (8, "released under the MIT license"),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    found = {(r.doc_id, r.text): r for r in licenses.scan(documents(rows)).collect()}
    got = [(found[k].licenses, found[k].notices) for k in rows]
    assert got[:4] == [(["MIT"], []), (["MIT"], ["MIT"]), ([], []), ([], ["Apache-2.0"])]
    assert [found[k].text_digest for k in rows[4:7]] == [None] * 3
    assert got[7] == (["MIT"], ["MIT"]) and got[9][0] == ["CC-BY-NC-4.0"]
    assert licenses.scan(documents(rows)).count() == len(rows)
    assert licenses.scan(documents(rows).limit(0)).count() == 0
    own = spark.createDataFrame([("L", hashlib.sha256(b"some words").hexdigest())], "license string, digest string")
    assert licenses.scan(documents([(1, "Some, WORDS!")]), own).first().licenses == ["L"]


def test_licenses_whole_texts(spark, documents):
    """Whole texts as they are found: with titles, without the appendix, re-wrapped, and notices of other licenses."""
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    texts = {n: (folder / f).read_text() for f, n in names.items()}
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    rows = [(i, t) for i, t in enumerate(texts.values())]
    wanted = [[n] for n in texts]
    rows += [
        (100, "MIT License\n\nCopyright (c) 2020 A. Author\n\n" + mit), (101, texts["Apache-2.0"].split("END OF TERMS")[0].replace("\n   ", "\n")),
        (102, texts["GPL-2.0-only"].replace("\n", "\r\n")), (103, texts["GPL-3.0-only"][:20_000]),
    ]
    wanted += [["MIT"], ["Apache-2.0"], ["GPL-2.0-only"], []]
    lines = ["// SPDX-License-Identifier: GPL-2.0-or-later", "Released under the BSD 3-Clause License", "# Licensed under CC BY 4.0.", "Licensed under the GNU General Public License, version 2 or later."]
    rows += [(200 + i, "prose\n" + x) for i, x in enumerate(lines)]
    found = {r.doc_id: r for r in licenses.scan(documents(rows)).collect()}
    assert [found[i].licenses for i, _ in rows[: len(wanted)]] == wanted
    assert [found[200 + i].notices for i in range(4)] == [["GPL-2.0-or-later"], ["BSD-3-Clause"], ["CC-BY-4.0"], ["GPL-2.0-or-later"]]
    known = licenses.known_digests(spark)
    assert known.groupBy("digest").count().filter("count > 1").isEmpty()


def test_license_notices_by_line(given):
    docs = given("documents")
    form = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    known = {form(t).replace("licence", "license"): n for n, t in licenses.KNOWN}
    expected = {r.doc_id: sorted({known[form(x)] for x in r.text.split("\n") if form(x) in known}) for r in docs.collect()}
    assert {r.doc_id: r.notices for r in licenses.scan(docs).collect()} == expected


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow does  a join work?\n\nThanks"),
        (1, 1, "assistant", "On Monday, user wrote:\n> how does a JOIN work?\nIt matches keys."),
        (1, 2, "user", "> It matches keys.\n> > How does a join work?\nAnd skew?"),
        (1, 3, "user", "> never said\nalone"),
        (1, 4, "assistant", ">> Hello there.\n>> How does a join work?\n> > And skew?\nSalt it."),
        (2, 1, "user", "> It matches keys.\nother conversation"),
        (2, 2, None, None), (None, 3, "user", "> x"), (2, None, "user", "> other conversation"),
        (3, 0, "user", "x > y"), (3, 1, "user", "> x > y"), (3, 1, "user", "> x > y"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = quotations.conversations(table).collect()
    assert len(found) == len(rows)
    got = {(r.conv_id, r.turn): (r.body, r.n_quotes, r.n_linked, r.parent_turn, r.root_turn, r.depth) for r in found}
    assert got[1, 0] == (rows[0][3], 0, 0, None, 0, 0)
    assert got[1, 1] == ("It matches keys.", 1, 1, 0, 0, 1)
    assert got[1, 2] == ("And skew?", 2, 2, 1, 0, 2)
    assert got[1, 3] == ("alone", 1, 0, None, 3, 0)
    assert got[1, 4] == ("Salt it.", 1, 1, 2, 0, 3)
    assert got[2, 1] == ("other conversation", 1, 0, None, 1, 0)
    assert got[2, 2] == (None, 0, 0, None, 2, 0)
    assert got[None, 3] == ("", 1, 0, None, 3, 0) and got[2, None][3:] == (None, None, 0)
    assert got[3, 0][0] == "x > y" and got[3, 1] == ("", 1, 1, 0, 0, 1)
    assert quotations.conversations(table.limit(0)).count() == 0


def test_quoted_paragraph_of_another_width(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nA join meets rows of\ntwo tables by key\nand keeps both.\n\nThanks a lot."),
        (1, 1, "user", "Something else."),
        (1, 2, "assistant", "> A join meets\n> rows of two tables by\n> key and keeps both.\nYes."),
        (1, 3, "assistant", "> not said\n>\n> A join meets rows\n> of two tables by key and keeps both.\nNo."),
        (1, 4, "assistant", "> A join meets rows\n> of two\nNo paragraph."),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.turn: (r.n_linked, r.parent_turn, r.root_turn) for r in quotations.conversations(table).collect()}
    assert found == {0: (0, None, 0), 1: (0, None, 1), 2: (1, 0, 0), 3: (1, 0, 0), 4: (0, None, 4)}


def test_quotations_over_a_table(spark, given):
    """Quotes put into every third message of the given table are found again, and nothing else changes."""
    rows = sorted(map(tuple, given("conversations").select("conv_id", "turn", "role", "text").collect()))
    first = {}
    for c, t, _, x in rows:
        for line in x.split("\n"):
            first.setdefault((c, " ".join(line.lower().split())), t)
    quoted, parents = [], {}
    for n, (c, t, role, x) in enumerate(rows):
        if n % 3 == 2 and rows[n - 1][0] == c:
            line = rows[n - 1][3].split("\n")[0]
            parents[c, t] = first[c, " ".join(line.lower().split())]
            x = f"> {line.upper() if line.isascii() else line}\n{x}"
        quoted.append((c, t, role, x))
    table = spark.createDataFrame(quoted, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r for r in quotations.conversations(table).collect()}
    assert {k: r.parent_turn for k, r in found.items() if r.parent_turn is not None} == parents and parents
    assert all(found[c, t].body == x.strip("\n") or (c, t) not in parents for c, t, _, x in rows)
