"""License scans against Python's regular expressions and a quadratic suppression."""

import random
import re

from docketry.llm import license_rules as rules

WORDS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected(text):
    words = WORDS.findall(lowered(text))
    normal = " " + " ".join(words) + " "
    places = []
    for phrase, label in rules.BASE:
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    found = []
    patterns = [
        (f"{b}(?:{name}){a}", priority, label)
        for label, _, name in rules.FAMILIES
        for b, a, priority, _ in rules.FORMS
    ] + [(f"(?:{wording})", priority, label) for label, _, wording, priority, _ in rules.SINGLE] + [
        (f"{before}(?:{name})(?: or later| only| licen[cs]e)?", priority, label)
        for label, name in rules.IDENTIFIERS
        for before, priority, _ in rules.IDENTIFIER_FORMS
    ]
    for pattern, priority, label in patterns:
        for m in re.finditer(f"(?<= ){pattern}(?= )", normal):
            first = len(normal[: m.start()].split())
            found.append((first, first + len(m[0].split()), priority, label))
    found = sorted(set(found), key=lambda s: (s[0], -s[1], s[2], s[3]))
    kept = []
    for i, s in enumerate(found):
        if not any(j != i and o[0] <= s[0] and o[1] >= s[1] and o[2] <= s[2] and (o[:3] != s[:3] or j < i) for j, o in enumerate(found)):
            kept.append(s)
    return len(words), sorted(places), kept


def actual(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = rules.scan(docs).orderBy("doc_id").collect()
    return [
        (r.n_words, sorted((b.place, b.label) for b in r.base), [(s.first, s.end, s.priority, s.label) for s in r.spans])
        for r in rows
    ]


TEXTS = [
    None,
    "",
    " \n",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
    "All rights reserved. ALL RIGHTS RESERVED all rights, reserved",
    "cc by cc by cc by-sa 4.0 cc-by",
    "écc by ccby cc bý general public licence GNU GPL v2 LGPL-2.1",
    "SPDX-License-Identifier: Apache-2.0 see the MIT license for details",
    "Permission is hereby granted, free of charge, to any person obtaining a copy; without warranty of any kind",
    "Copyright (c) 2019 someone. Some rights reserved, trademark of; dual licensed under the terms of the MPL",
    "x " * 3000 + "mozilla public license 2.0 " * 300,
]


def test_texts_by_hand(spark):
    assert actual(spark, TEXTS) == [expected(t) for t in TEXTS]


def test_hundreds_of_rules():
    assert len(rules.FAMILIES) * len(rules.FORMS) + len(rules.SINGLE) > 200


def test_every_wording_has_a_keyword_and_a_gate(spark):
    """A text that is nothing but one rule's wording passes the keyword filter and the rule's gate."""
    names = [
        "apache license 2.0", "mit license", "new bsd license", "gnu gpl license", "lesser general public license",
        "affero general public license", "unlicense", "cc by 4.0", "creative commons license", "eclipse public license",
    ]
    found = actual(spark, [f"licensed under the {n}" for n in names])
    assert all(f[2] for f in found)


def test_random_mixtures(spark):
    random.seed(3)
    stock = (
        "licensed released under the terms of gnu general public license version 2 3 0 4 cc by nc sa apache mit bsd "
        "clause all rights reserved copyright c 2020 see for details lgpl gpl v3 spdx identifier a word Ö . , - \n"
    ).split(" ")
    texts = [" ".join(random.choice(stock) for _ in range(random.randint(0, 60))) for _ in range(400)]
    assert actual(spark, texts) == [expected(t) for t in texts]


def test_summary_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "cc by", "x", 1), (7, None, None, 2), (7, None, None, 2), (8, "MIT License", "y", 3)],
        "doc_id long, text string, labels string, n_words int",
    )
    rows = rules.summary(rules.scan(docs)).collect()
    wanted = [
        (None, 2, 1, 0, 0, "cc-by", "cc-by"),
        (7, 0, 0, None, None, "", ""),
        (7, 0, 0, None, None, "", ""),
        (8, 2, 0, None, None, "", "mit"),
    ]
    assert sorted((tuple(r)[:7] for r in rows), key=repr) == sorted(wanted, key=repr)
    assert all(0 <= r.score <= 1 for r in rows)
    assert rules.summary(rules.scan(docs.limit(0))).count() == 0


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    rules.summary(rules.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan


def wordings(pattern):
    """Every text that a rule's expression matches, with one character of each class and one count of each repeat but 0 or 1."""

    def expand(parsed):
        texts = [""]
        for kind, value in parsed:
            kind = str(kind)
            if kind == "LITERAL":
                more = [chr(value)]
            elif kind == "IN":
                first = value[0][1]
                more = [chr(first if isinstance(first, int) else first[0])]
            elif kind == "SUBPATTERN":
                more = expand(value[3])
            elif kind == "BRANCH":
                more = [t for branch in value[1] for t in expand(branch)]
            elif kind == "MAX_REPEAT":
                low, high, inner = value
                inner = expand(inner)
                more = [""] * (low == 0) + ([t * max(low, 1) for t in inner] if high else [])
            else:
                raise ValueError(kind)
            texts = [a + b for a in texts for b in more]
        return texts

    return expand(re._parser.parse(pattern))


def test_every_alternative_of_every_rule_alone(spark):
    """Each wording as the only text: the keyword filter and the gate let it through to its rule."""
    stock = [(label, t) for label, _, name in rules.FAMILIES for t in wordings(name)]
    stock += [(label, t) for label, _, wording, _, _ in rules.SINGLE for t in wordings(wording)]
    assert len(stock) > 300 and ("mit", "expat licence") in stock and ("no-warranty", "provided as is") in stock
    texts = [t for _, t in stock] + ["Licensed under the Creative Commons Attribution 4.0 International License", 'provided "AS IS".']
    found = actual(spark, texts)
    assert [(t, f) for t, f in zip(texts, found) if f != expected(t)] == []
    assert all(f[2] for f in found)


def test_gates_let_every_alternative_through():
    for label, gate, wording in [f[:3] for f in rules.FAMILIES] + [s[:3] for s in rules.SINGLE]:
        assert [t for t in wordings(wording) if not re.search(gate, t) or not re.search(rules.KEYWORDS, t)] == [], label


#: What published identifiers and notices stand for, written apart from the rules.
PUBLISHED = """
SPDX-License-Identifier: MIT > mit
SPDX-License-Identifier: MIT-0 > mit-0
SPDX-License-Identifier: ISC > isc
SPDX-License-Identifier: Zlib > zlib
SPDX-License-Identifier: Apache-1.1 > apache-1.1
SPDX-License-Identifier: Apache-2.0 > apache-2.0
SPDX-License-Identifier: BSD-2-Clause > bsd-2-clause
SPDX-License-Identifier: BSD-3-Clause > bsd-3-clause
SPDX-License-Identifier: BSD-4-Clause > bsd-4-clause
SPDX-License-Identifier: GPL-1.0-only > gpl-1.0
SPDX-License-Identifier: GPL-2.0-only > gpl-2.0
SPDX-License-Identifier: GPL-2.0-or-later > gpl-2.0
SPDX-License-Identifier: GPL-3.0+ > gpl-3.0
SPDX-License-Identifier: LGPL-2.1-or-later > lgpl-2.1
SPDX-License-Identifier: LGPL-3.0-only > lgpl-3.0
SPDX-License-Identifier: AGPL-3.0-or-later > agpl-3.0
SPDX-License-Identifier: GFDL-1.3-or-later > gfdl
SPDX-License-Identifier: MPL-1.1 > mpl-1.1
SPDX-License-Identifier: MPL-2.0 > mpl-2.0
SPDX-License-Identifier: EPL-1.0 > epl-1.0
SPDX-License-Identifier: EPL-2.0 > epl-2.0
SPDX-License-Identifier: EUPL-1.2 > eupl
SPDX-License-Identifier: CDDL-1.0 > cddl
SPDX-License-Identifier: CPL-1.0 > cpl-1.0
SPDX-License-Identifier: Artistic-2.0 > artistic-2.0
SPDX-License-Identifier: BSL-1.0 > boost-1.0
SPDX-License-Identifier: OpenSSL > openssl
SPDX-License-Identifier: PHP-3.01 > php
SPDX-License-Identifier: PSF-2.0 > python
SPDX-License-Identifier: Ruby > ruby
SPDX-License-Identifier: WTFPL > wtfpl
SPDX-License-Identifier: Unlicense > unlicense
SPDX-License-Identifier: OFL-1.1 > ofl-1.1
SPDX-License-Identifier: ODbL-1.0 > odbl
SPDX-License-Identifier: PostgreSQL > postgresql
SPDX-License-Identifier: MS-PL > ms-pl
SPDX-License-Identifier: MS-RL > ms-rl
SPDX-License-Identifier: CC0-1.0 > cc0-1.0
SPDX-License-Identifier: CC-BY-3.0 > cc-by-3.0
SPDX-License-Identifier: CC-BY-4.0 > cc-by-4.0
SPDX-License-Identifier: CC-BY-SA-4.0 > cc-by-sa
SPDX-License-Identifier: CC-BY-NC-4.0 > cc-by-nc
SPDX-License-Identifier: CC-BY-ND-4.0 > cc-by-nd
SPDX-License-Identifier: CC-BY-NC-SA-4.0 > cc-by-nc-sa
SPDX-License-Identifier: CC-BY-NC-ND-4.0 > cc-by-nc-nd
Licensed under GPLv2 or later. > gpl-2.0
Licensed under GPLv3 > gpl-3.0
License: GPLv2+ > gpl-2.0
released under LGPLv2.1 > lgpl-2.1
Distributed under the terms of AGPLv3 > agpl-3.0
Licensed under the MPL 2.0 > mpl-2.0
licensed under MIT > mit
licensed under the MIT or Apache-2.0 license > apache-2.0,mit
Released under the ISC license > isc
Licensed under the Apache License, Version 2.0 (the "License") > apache-2.0
This program is free software under the GNU General Public License, version 2 > gpl-2.0
Published under the Creative Commons Attribution 4.0 license > cc-by-4.0
distributed under the Boost Software License, Version 1.0 > boost-1.0
This is free and unencumbered software released into the public domain > public-domain
Permission is hereby granted, free of charge, to any person obtaining a copy of this software > mit
Licensed under the EUPL-1.2 > eupl
"""


def test_published_identifiers_and_notices(spark):
    wanted = [line.split(" > ") for line in PUBLISHED.strip().split("\n")]
    assert len(wanted) >= 60
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(wanted)], "doc_id long, text string")
    rows = {r.doc_id: r for r in rules.summary(rules.scan(docs)).collect()}
    missed = [(t, rows[i].labels) for i, (t, labels) in enumerate(wanted) if not set(labels.split(",")) <= set(rows[i].labels.split(","))]
    assert missed == [] and all(r.score >= 0.6 for r in rows.values())
    assert actual(spark, [t for t, _ in wanted]) == [expected(t) for t, _ in wanted]
