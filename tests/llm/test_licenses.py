import random
import re
import time
from collections import Counter

from inkveil.llm import licenses


def brute_passages(text, templates, threshold):
    """The best likeness of each license over every run of words."""
    w = re.findall(r"[^\W_]+", text.lower())
    best = {}
    for name, template in templates:
        t = re.findall(r"[^\W_]+", template.lower())
        own = Counter(zip(t, t[1:]))
        for s in range(len(w) - 1):
            for e in range(s + 2, min(len(w), s + 2 * len(t)) + 1):
                bag = Counter(zip(w[s:e], w[s + 1 : e]))
                likeness = 2 * sum((bag & own).values()) / (sum(bag.values()) + sum(own.values()))
                if likeness >= threshold:
                    best[name] = max(best.get(name, 0), likeness)
    return best


def test_whole_table(spark, sf_dir):
    """Every text, cut to the surroundings of a word of a license's bigrams: elsewhere nothing can match."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    templates = [(n, re.findall(r"[^\W_]+", t.lower())) for n, t in licenses.TEMPLATES]
    pairs = {b for _, t in templates for b in zip(t, t[1:])}
    reach = max(len(t) for _, t in templates) * 2
    for r in docs.collect():
        w = re.findall(r"[^\W_]+", (r.text or "").lower())
        hits = [i for i in range(len(w) - 1) if (w[i], w[i + 1]) in pairs]
        best = {}
        for name, t in templates:
            own = Counter(zip(t, t[1:]))
            at = [i for i in hits if (w[i], w[i + 1]) in own]
            for x, s in enumerate(at):  # a likest run begins and ends with a bigram of the template
                bag = Counter()
                for y in at[x:]:
                    if y - s > reach:
                        break
                    bag[w[y], w[y + 1]] += 1
                    likeness = 2 * sum((bag & own).values()) / (y - s + 1 + len(t) - 1)
                    if likeness >= 0.8:
                        best[name] = max(best.get(name, 0), likeness)
        row = got[r.doc_id]
        assert (row.n_matches > 0) == bool(best)
        assert row.likeness == (max(best.values()) if best else None)
        if best:
            assert best[row.license] == row.likeness and set(row.licenses.split(",")) <= set(best)
            assert {n for n, x in best.items() if x == row.likeness} <= set(row.licenses.split(","))


def test_full_texts_and_rivals(spark):
    by = {}
    for name, t in licenses.TEMPLATES:
        if len(t) > len(by.get(name, "")):
            by[name] = t
    names = ["0BSD", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "Unlicense", "Zlib", "GPL-2.0", "GPL-3.0", "LGPL-3.0"]
    texts = [f"Copyright 2001 someone\n\n{by[n]}\n\nEnd of file." for n in names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(tuple(r) for r in licenses.license_report(docs).collect())
    assert rows == [(i, 1, n, 1.0, n) for i, n in enumerate(names)]


def test_time_in_proportion_to_hits():
    own = licenses.scanner(tuple(licenses.TEMPLATES), 0.8)

    def took(lines):
        text = "Released under the MIT License.\n" * lines
        began = time.process_time()
        found = own.passages(text)
        assert len(found) == lines and {f[:2] for f in found} == {("MIT", 1.0)}
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 8 * took(10_000)


def test_nulls_repeats_long_and_empty(spark):
    long = "the work of this license under a " * 20000
    docs = spark.createDataFrame([(1, None, 1), (None, "", 1), (2, long + "\nReleased under the MIT License.\n" + long, 1), (2, "x", 1), (2, "x", 1), (3, "license", 1)], "doc_id bigint, text string, matches int")
    rows = licenses.license_report(docs).collect()
    assert sorted((str(r.doc_id), r.n_matches, r.license) for r in rows) == sorted([("1", 0, None), ("None", 0, None), ("2", 1, "MIT"), ("2", 0, None), ("2", 0, None), ("3", 0, None)], key=str)
    assert licenses.license_report(docs.limit(0)).count() == 0


def test_notices_inside_longer_lines(spark):
    grant = next(t for _, t in licenses.TEMPLATES if t.startswith("Permission is hereby"))
    texts = ["All of this code is released under the MIT License.", "See also: this project is released under the MIT License. Thanks.", "some other words " * 3000 + grant + " and more of them" * 3000, "Text.\nMore text, licensed under\nCC BY 4.0. And more."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(tuple(r)[:4] for r in licenses.license_report(docs).collect())
    assert rows == [(0, 1, "MIT", 1.0), (1, 1, "MIT", 1.0), (2, 1, "MIT", 1.0), (3, 1, "CC-BY-4.0", 1.0)]
    assert licenses.scanner(tuple(licenses.TEMPLATES), 0.8).passages(texts[3])[0][2:] == (1, 2)


def test_best_passage_matches_brute_force():
    rng = random.Random(3)
    words = "licensed under the mit license version a of this work is cc by 4 0".split()
    templates = [t for t in licenses.TEMPLATES if len(t[1]) < 120]
    for _ in range(25):
        parts = [rng.choice(words) for _ in range(rng.randrange(20))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(templates)[1])
        text = " ".join(parts)
        got = licenses.scanner(tuple(templates), 0.8).passages(text)
        best = brute_passages(text, templates, 0.8)
        for name, likeness, *_ in got:
            assert likeness <= best[name]
        top = max(best.values())
        assert {x[0] for x in got if x[1] == top} == {n for n, x in best.items() if x == top}


def test_headers_and_headings_of_long_licenses(spark):
    """As they are usually wrapped and prefixed, within other text."""
    wrap = lambda t: "\n".join(" * " + " ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <http://www.gnu.org/licenses/>."
    rows = [
        (1, "/*\n" + wrap(gpl) + "\n */\nint main() {}", "GPL-3.0"),
        (2, wrap(gpl.replace("GNU General", "GNU Affero General")), "AGPL-3.0"),
        (3, wrap(gpl.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")), "GPL-2.0"),
        (4, wrap(gpl.replace("program", "library").replace("GNU General", "GNU Lesser General")), "LGPL-3.0"),
        (5, "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <http://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble", "GPL-3.0"),
        (6, "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n 1. Definitions.", "Apache-2.0"),
        (7, "See the general terms of the public license of the library for more details of the program.", None),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.licenses) for r in licenses.license_report(docs).collect()}
    assert got == {i: (name, name or "") for i, _, name in rows}
