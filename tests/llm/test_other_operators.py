"""Operators on pages, vectors, conversations and files, and the pipeline."""

import math
import random
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from helper import same_rows
from folioframe.llm import bitsliced, html_lstm, licenses, preference, queries
from folioframe.llm._groups import components


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark, duck, data):
    same_rows(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLES[name]))


# HTML


@pytest.mark.parametrize("page, texts", [
    ("<p>a  b\n c</p><p>&amp;&copy;&#233;&unknown; &am", ["a b c", "&©é&unknown; &am"]), ("<div>x<br>y<b>z</b></div>", ["x yz"]), ("<script>var t='</p>';</script><style>p{}</style>k", ["k"]),
    ("a<!-- <p>no</p> -->b<!-- open", ["ab"]), ("<p>one<p>two<ul><li>x<li>y</ul>", ["one", "two", "x", "y"]), ('<a href="a>b">t</a> < 3 <', ["t < 3 <"]), ("", []), ("<p></p> <div>\t</div>", []), ("</div></p>text</x>", ["text"]),
    ("<script>never closed <p>x", []), ("<td>1</td><td>2</td>", ["1", "2"]),
])
def test_blocks(page, texts):
    assert [b.text for b in html_lstm.blocks(page)] == texts


@pytest.mark.parametrize("page, texts", [
    ('<article><svg class="i"/><p>one two</p><p>three</p></article>', ["one two", "three"]), ("<p>a</p><title-bar>x</title-bar><p>real text</p>", ["a", "x", "real text"]), ("<template-x><p>k</p></template-x><p>l", ["k", "l"]),
    ("<div><select><option>a<option>b</div><p>text</p>", ["text"]), ("<select><option>a<p>text</p><select><option>b</select>end", ["text", "end"]), ("<p>a<svg><path d=''><title/><text>no</text></svg>b</p>", ["ab"]),
    ("<svg><g><p>text</p>", ["text"]), ("<div><svg><foreignObject><div>no</div></foreignObject></svg>text</div>", ["text"]), ("<template><div></div><template>x</template>y</template>z", ["z"]), ("<div><template><p>a</div><p>b", ["b"]),
    ("<noscript><img src=x>no</noscript>a<noscript>b", ["a", "b"]), ("<title>t</title><textarea>no <p></textarea><iframe>x", []), ("<svg href=a/>no</svg>yes", ["yes"]), ("<script>a</scripty></script >b", ["b"]),
])
def test_blocks_around_hidden_elements(page, texts):
    assert [b.text for b in html_lstm.blocks(page)] == texts


@pytest.mark.parametrize("page, texts", [
    ("<div data-x=O'Brien>First para.</div><div data-x=D'Arcy>Second.</div>", ["First para.", "Second."]), ('<a href=/x"y>one</a> and <a href=/z"w>two</a>', ["one and two"]), ("<p>AT&<i>amp;T</i>", ["AT&amp;T"]),
    ("<p a=\"b>c\">k<p a='x>\"y'>l<p =a>m<p a= >n<p a = b/>o", ["k", "l", "m", "n", "o"]), ('<p title="never closed>d</p>', ["d"]), ("<!-->a<!--->b<!-- x --!>c", ["abc"]), ("<p class='a' data-x='class=nav'>x", ["x"]),
])
def test_blocks_with_odd_attributes(page, texts):
    assert [b.text for b in html_lstm.blocks(page)] == texts


def test_blocks_hold_the_text_that_the_event_parser_sees():
    """Against the standard library's parser, on random pages of tags, attributes, references and comments."""
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def handle_data(self, data):
            self.out += data

        def handle_starttag(self, tag, attrs):
            self.out += " " * (tag not in html_lstm._INLINE or tag == "br")

        def handle_endtag(self, tag):
            self.out += " " * (tag not in html_lstm._INLINE)

    rng = random.Random(9)
    parts = ["<p>", "</p>", "<div class=a>", '<div id="x>y">', "</div>", "<a href=/o'b?c=1&amp;d>", "</a>", "<b title='\"q\" > r'>", "</b>", "<br/>", "<img alt=\"a'b\" src=x>", "<!-- <p>no</p> -->", "&amp;", "&lt;b&gt;", "&#233;", "&copy;", " ", "\n\t", "word", "x< y", "a & b", "1 < 2", "é"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        seen = Texts()
        seen.out = ""
        seen.feed(page)
        seen.close()
        assert "".join("".join(b.text for b in html_lstm.blocks(page)).split()) == "".join(seen.out.split()), page


def test_labeller_on_pages_written_by_hand():
    from layouts import LAYOUTS

    net = html_lstm.train([])
    right = total = 0
    for page, want in LAYOUTS.values():
        found = html_lstm.blocks(page)
        assert [b.text for b in found if b.text in want] == want
        for b, x in zip(found, net.main([found])[0]):
            right += (b.text in want) == x
            total += 1
    assert right >= 0.93 * total


def test_extraction_of_given_pages(spark, data):
    rows = {r["page_id"]: r for r in queries.op2_html_lstm(spark, data).collect()}
    right = 0
    for p in spark.read.parquet(f"{data}/pages.parquet").collect():
        found = html_lstm.blocks(p["html"])
        want = "\n".join(b.text for b, x in zip(found, html_lstm.told_by_elements(found)) if x)
        r = rows[p["page_id"]]
        right += r["text"] == want
        assert r["n_chars"] == len(r["text"]) and r["url"] == p["url"]
    assert right >= 0.95 * len(rows)


def test_labeller_generalises():
    net = html_lstm.train([])
    pages, labels = html_lstm.generated(77, 80)
    got = net.main(pages)
    assert np.mean(np.concatenate(got) == np.concatenate(labels)) > 0.95


def test_labeller_gradients():
    net = html_lstm.Labeller(seed=1)
    pages, labels = html_lstm.generated(5, 3)
    q, y = html_lstm.Inputs(pages), np.concatenate(labels).astype(float)
    grads = net._gradients(q, y)

    def loss() -> float:
        s = net._forward(q)[0]
        return float(np.mean(np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0) - s * y))

    rng = np.random.default_rng(0)
    for p, g in ((net.gates, grads[2]), (net.shift, grads[3]), (net.out, grads[4]), (net.path, grads[0])):
        for _ in range(3):
            at = np.unravel_index(rng.choice(np.flatnonzero(np.abs(g.ravel()) > np.abs(g).max() / 50)), p.shape)
            keep = p[at]
            p[at] = keep + 1e-5
            up = loss()
            p[at] = keep - 1e-5
            down = loss()
            p[at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_batches_do_not_change_labels():
    net = html_lstm.train([])
    pages, _ = html_lstm.generated(6, 12)
    assert all(np.array_equal(a, net.main([p])[0]) for a, p in zip(net.main(pages + [[]]), pages))


def test_html_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, None, "<article><p>text of an article, long enough.</p></article>"), (4, "u", "<p>" * 3000 + "deep"), (4, "u", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = html_lstm.extract(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert html_lstm.extract(df.where("false")).collect() == []


# top-k


def brute_top(rows, k, every):
    q = [(i, np.array([math.floor(64 * Fraction(x)) for x in v], object)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in q:
        if i is not None and i % every == 0:
            best = sorted((-int(v @ w), j is None, j or 0) for j, w in q if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, None if m else j, -s) for n, (s, m, j) in enumerate(best)]
    return sorted(out, key=str)


def test_top_k(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.2) if k % 3 else 0.25 * rng.randrange(3) for _ in range(6)]) for k in range(150)]
    rows += [(None, [0.1] * 6), (151, None), (152, []), (160, []), (153, [1.0, None] + [0.0] * 4), (154, [float("nan")] * 6), (155, [float("inf")] * 6), (156, [3.5] * 2), (180, [-1.0, 2.0]), (190, [100.0, -77.3, 0.0, 5.0, 1.0, -0.001])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for size in (32_768, 40):
        monkeypatch.setattr(bitsliced, "INDEX_ROWS", size)
        monkeypatch.setattr(bitsliced, "QUERY_ROWS", size // 10)
        got = sorted([tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 10 == 0, k=7).collect()], key=str)
        assert got == brute_top(rows, 7, 10)
    for tasks in (1, 50):  # runs of one and of many query blocks
        monkeypatch.setattr(bitsliced, "TASKS", tasks)
        assert sorted([tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 10 == 0, k=7).collect()], key=str) == brute_top(rows, 7, 10)
    assert bitsliced.top_k(df.where("false"), F.col("vec_id") % 10 == 0).collect() == []


def test_top_k_of_wide_components(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [float(np.float32(rng.gauss(0, 0.3) * (1 if k % 4 else 10.0 ** rng.randrange(5, 8)))) for _ in range(5)]) for k in range(90)]
    rows += [(200, [2.0**25, 0.0, 0.0, 0.0, -(2.0**24)]), (201, [-1.0, 2.0**26, 0.25, -700_000.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for size, wide in ((32_768, 4_096), (40, 3)):
        monkeypatch.setattr(bitsliced, "INDEX_ROWS", size)
        monkeypatch.setattr(bitsliced, "QUERY_ROWS", size // 10)
        monkeypatch.setattr(bitsliced, "WIDE_ROWS", wide)
        got = sorted([tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 10 == 0, k=7).collect()], key=str)
        assert got == brute_top(rows, 7, 10)
    # huge components, where all results fit
    rows = [(k, [0.5 if k % 3 else 0.0, k / 16, -1.0]) for k in range(40)] + [(41, [-1e30, 2.0, 0.25]), (43, [-3e38, 2.0, 0.25]), (47, [-(2.0**57), 70.0, 0.0]), (50, [0.0, -(2.0**80), 0.0]), (60, [0.0, 0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted([tuple(r) for r in bitsliced.top_k(df, (F.col("vec_id") % 10 == 0) & (F.col("vec_id") != 50), k=7).collect()], key=str) == [r for r in brute_top(rows, 7, 10) if r[0] != 50]
    block = bitsliced.SlicedBlock(np.arange(9), np.ones(9, bool), np.array([[2**60 - j, -(2**61), j] for j in range(9)]))
    for q in ([3, 1, -5], [2**61, 2**60, 7], [-1, 0, 2**40]):
        want = sorted(((sum(a * b for a, b in zip(q, [2**60 - j, -(2**61), j])), -j) for j in range(9)), reverse=True)[:4]
        places, scores = block.top(np.array(q), None, 4)
        assert sorted(zip(scores.tolist(), (-places).tolist()), reverse=True) == [(min(max(s, -(2**63)), 2**63 - 1), j) for s, j in want]
    with pytest.raises(Exception, match="leaves 64 bits"):
        bitsliced.top_k(spark.createDataFrame([(1, [1e12]), (2, [1e12])], "vec_id long, embedding array<double>"), F.col("vec_id") == 1).collect()


def test_top_k_query(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert sorted([tuple(r) for r in queries.op6_bit_sliced_top_k(spark, data).collect()], key=str) == brute_top(rows, 20, 20)


# licenses


def test_licenses_inherit_from_the_nearest_folder(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"), ("a/b/x.py", "code"), ("a/b/c/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007 GNU General Public License"),
        ("a/b/c/d/y.py", "code"), ("a/b/c/z.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 20), ("q/x.py", None), (None, "All rights reserved."), (None, None), ("a/b/x.py", "code"), ("top.txt", "This licence is something else entirely and says so in many words"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "p string, t string, file int, dir string")
    got = sorted([(r["path"], r["license"], r["origin"], r["licence_path"]) for r in licenses.scan(df, F.col("p"), F.col("t")).collect()], key=str)
    assert got == sorted([
        ("a/LICENSE", "MIT", "own", None), ("a/b/x.py", "MIT", "inherited", "a"), ("a/b/x.py", "MIT", "inherited", "a"), ("a/b/c/COPYING", "GPL-3.0", "own", None), ("a/b/c/d/y.py", "GPL-3.0", "inherited", "a/b/c"),
        ("a/b/c/z.py", "Apache-2.0", "own", None), ("q/x.py", None, "none", None), (None, "Proprietary", "own", None), (None, None, "none", None), ("top.txt", None, "none", None),
    ], key=str)
    assert licenses.scan(df.where("false"), F.col("p"), F.col("t")).collect() == []


def test_licenses_of_very_long_texts_and_ties(spark):
    long = "word " * 60_000 + "Licensed under CC BY 4.0. " + "word " * 60_000
    tied = "Licensed under the MIT License. Licensed under CC BY 4.0."
    got = {r["path"]: (r["license"], r["score"]) for r in licenses.scan(spark.createDataFrame([("1/a", long), ("2/b", tied), ("3/c", ""), ("4/d", tied + " " + tied)], "p string, t string"), F.col("p"), F.col("t")).collect()}
    assert got == {"1/a": ("CC-BY-4.0", 1.0), "2/b": ("CC-BY-4.0", 1.0), "3/c": (None, None), "4/d": ("CC-BY-4.0", 1.0)}


def test_licenses_of_files_that_are_hardly_more_than_their_statement(spark):
    rows = [("r/info.txt", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("r/a.txt", "text " * 30), ("r/d/e/f.txt", "deep"), ("s/b.txt", "Released under the MIT License. " + "word " * 30), ("s/c.txt", "x")]
    got = {r["path"]: (r["license"], r["origin"], r["licence_path"]) for r in licenses.scan(spark.createDataFrame(rows, "p string, t string"), F.col("p"), F.col("t")).collect()}
    assert got == {"r/info.txt": ("CC-BY-4.0", "own", None), "r/a.txt": ("CC-BY-4.0", "inherited", "r"), "r/d/e/f.txt": ("CC-BY-4.0", "inherited", "r"), "s/b.txt": ("MIT", "own", None), "s/c.txt": (None, "none", None)}


# preference formatting


def test_licenses_of_published_texts(spark):
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
int main() {}"""
    go = """// Copyright 2019 The Go Authors. All rights reserved.
// Use of this source code is governed by a BSD-style
// license that can be found in the LICENSE file.
package x"""
    rows = [("a.c", "\n".join(f" * {x}" for x in gpl.split("\n")), "GPL-3.0"), ("b.c", gpl.replace("\n", " "), "GPL-3.0"), ("c.c", mpl, "MPL-2.0"), ("d.go", go, "BSD-3-Clause"), ("e.py", "# SPDX-License-Identifier: MIT\nx = 1", "MIT"), ("f.py", "# SPDX-License-Identifier: LGPL-2.1-or-later\nx = 1", "LGPL-2.1"), ("g.py", "# SPDX-License-Identifier: Frob-7\nx = 1", None)]
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    rows += [("j.c", "// Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("k.c", "GNU GENERAL PUBLIC LICENSE", "GPL-1.0-or-later"), ("l.c", bsd, "BSD-3-Clause"), ("m.c", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above", "ISC")]
    rows += [("n.c", "x " * 400 + "and this text is released under\n * the MIT\n * License, as we said " + "y " * 400, "MIT"), ("o.c", "nothing " * 50 + "rights and licenses of all kinds", None), ("p.c", "All rights reserved" + " word" * 20_000, "Proprietary")]
    rows += [("h.c", gpl.replace("version 3", "version 2"), "GPL-2.0"), ("i.c", gpl.replace("GNU General", "GNU Lesser General"), "LGPL-3.0")]
    common = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    found = [(Path("/usr/share/common-licenses", f), name) for f, name in common.items()]
    rows += [(f"common/{p.name}/LICENSE", p.read_text(), name) for p, name in found if p.exists()]
    got = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string"), F.col("path"), F.col("text")).collect()
    own = {r["path"]: r["license"] if r["origin"] == "own" else None for r in got}
    assert own == {p: name for p, _, name in rows}


def test_preference_pairs(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "A")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "BB"), (1, 4, "assistant", "C")]
    rows = [(p, "chosen", *x) for p, *x in c] + [(p, "rejected", *x) for p, *x in r] + [(1, "chosen", 0, "user", "hi")]
    rows += [(2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 0, None, None), (3, "rejected", None, "assistant", "x"), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "pair_id long, side string, turn long, role string, text string, cut int")
    got = {r["pair_id"]: r for r in preference.pairs(df, *(F.col(x) for x in ("pair_id", "side", "turn", "role", "text"))).collect()}
    shown = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got[1]["n_prompt_turns"] == 3 and got[1]["prompt"] == shown("user", "hi") + shown("assistant", "yes") + shown("user", "more")
    assert got[1]["chosen"] == shown("assistant", "A") and got[1]["rejected"] == shown("assistant", "BB") + shown("assistant", "C")
    for side, texts in (("chosen", ["A"]), ("rejected", ["BB", "C"])):
        spans = [tuple(map(int, s.split("-"))) for s in got[1][f"{side}_spans"].split(",")]
        assert [got[1][side][a:b] for a, b in spans] == texts
    assert got[2]["prompt"] == shown("user", "same") and got[2]["chosen"] == got[2]["rejected"] == got[2]["chosen_spans"] == ""
    assert got[3]["n_prompt_turns"] == 0 and got[3]["chosen"] == shown("", "") and set(got) == {1, 2, 3}
    assert preference.pairs(df.where("false"), *(F.col(x) for x in ("pair_id", "side", "turn", "role", "text"))).collect() == []


def test_preference_of_all_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (2, 0, "system", "s"), (2, 1, "user", "no answer"), (3, 0, "user", "q3"), (3, 1, "assistant", "a3"), (None, 0, "user", "lost"), (4, 0, "assistant", "x" * 300_000), (4, 0, "assistant", "x" * 300_000)]
    turns = preference.with_next_answer(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["pair_id"]: r for r in preference.pairs(turns, *(F.col(c) for c in ("pair_id", "side", "turn", "role", "text"))).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2]["n_prompt_turns"] == 2 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert ["a3" in got[1]["rejected"], "x" * 300_000 in got[3]["rejected"], "a1" in got[4]["rejected"], len(got[4]["chosen"])] == [True, True, True, 300_000 + len("<|assistant|>\n<|end|>\n")]


# components, pipeline


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + k, 501 + k) for k in range(40)] + [(900, 900)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if x != 900}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_pipeline(spark, edge, data):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "mix", "encode"] and cp.ORACLE_SQL is None
    rows = cp.run(spark, data).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert 0 < len(rows) and all(r["doc_id"] in docs for r in rows)
    for stage in (cp.near_duplicates, cp.mix, cp.quality):
        out = stage(spark, edge, data)
        assert out.columns == edge.columns
        assert stage(spark, edge.where("false"), data).collect() == []
    kept = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, edge, data).collect()]
    assert len(kept) == len(set(kept)) and sum(t == "repeated row text here" for _, t in kept) == 1
    assert {(9, "same id"), (9, "other text of that id"), (None, "null id here"), (2, ""), (1, None), (3, " \t\n ")} <= set(kept)
    assert cp.encode(spark, edge, data).count() == edge.count()
    assert cp.encode(spark, edge.where("false"), data).collect() == []


def test_pipeline_of_edge_cases(spark, edge, tmp_path):
    """The whole run over nulls, empty and long texts, repeated rows, clashing columns, and over an empty table."""
    import corpus_pipeline as cp

    for name, docs in (("edge", edge), ("none", edge.where("false"))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(2, 1), (3, 1), (6, 1), (9, 1), (10, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        rows = cp.run(spark, folder).collect()
        assert (len(rows) > 0) == (name == "edge") and all(r["n_tokens"] >= 0 for r in rows)
        # one of the rows that are equal or hold the same text is left, as often as the mix takes it
        taken = [r["doc_id"] for r in rows if r["doc_id"] in (7, 8)]
        assert set(taken) <= {7} and len(taken) <= 3 and (6 in {r["doc_id"] for r in rows}) == (name == "edge")


def test_pipeline_keeps_one_of_each_group(spark, data):
    import corpus_pipeline as cp
    from test_text_operators import brute_links

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {c for _, n, c, _ in brute_links(rows, 5, 8, 10) if n}
    assert {r["doc_id"] for r in cp.near_duplicates(spark, docs, data).collect()} == want
