import random

import pytest

from pedalgrid.llm import license_scan as L

GNU = (
    "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {name}General Public\n"
    "License as published by the Free Software Foundation; either\nversion {n} of the License, or (at your option) any later version."
)
CC = "This work is licensed under a Creative Commons Attribution{name} 4.0 International License."
SHORT = "Licensed under CC BY{name} 4.0"


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + "the of and to a in is this that all for copy software use library version".split()
    return L.train([" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(4, 30))) for _ in range(600)])


CASES = [
    ("gpl-2.0", GNU.format(name="", n="2")),
    ("gpl-3.0", GNU.format(name="", n="3")),
    ("lgpl-2.1", GNU.format(name="Lesser ", n="2.1")),
    ("lgpl-3.0", GNU.format(name="Lesser ", n="3")),
    ("agpl-3.0", GNU.format(name="Affero ", n="3")),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"),
    ("bsd-2-clause", "Released under the BSD 2-Clause License"),
    ("bsd", "Released under the BSD 3-Clause License"),
    *((f"cc-by{k}", f.format(name=v)) for f, names in (
        (CC, {"": "", "-sa": "-ShareAlike", "-nd": "-NoDerivatives", "-nc": "-NonCommercial", "-nc-sa": "-NonCommercial-ShareAlike", "-nc-nd": "-NonCommercial-NoDerivatives"}),
        (SHORT, {"": "", "-sa": "-SA", "-nd": "-ND", "-nc": "-NC", "-nc-sa": "-NC-SA", "-nc-nd": "-NC-ND"}),
    ) for k, v in names.items()),
]


@pytest.mark.parametrize("family, text", CASES)
def test_the_right_member_of_a_kin(model, family, text):
    for whole in (text, f"w1 w2 the w3\n\n{text}\n\nw5 w6 of it", " ".join(text.split()), "\n".join("# " + x for x in text.split("\n"))):
        assert {f for f, _ in model.scan(whole)} == {family}, whole


@pytest.mark.parametrize(
    "text",
    [
        GNU.format(name="Library ", n="2"),
        GNU.format(name="Lesser ", n="4"),
        "Licensed under the Apache License, Version 1.1",
        "Licensed under the Eclipse Public License 2.0",
        "Licensed under the European Union Public Licence 1.2",
        "Released under the Artistic License 2.0",
        "Distributed under the Boost Software License, Version 1.0",
        "The museum was founded in copyright 2024 of the city",
    ],
)
def test_a_family_that_is_not_listed_is_no_other(model, text):
    assert model.scan(text) == []


def test_every_template_is_its_own_family(model):
    for family, texts in L.TEMPLATES.items():
        for text in texts:
            assert model.judge(text) is not None and model.judge(text)[0] == family, text


def test_shortest_stretch_equals_all_stretches():
    rnd = random.Random(8)
    for _ in range(400):
        words = [rnd.choice("abcde") for _ in range(rnd.randint(0, 14))]
        pairs = {(rnd.choice("abcde"), rnd.choice("abcde")) for _ in range(rnd.randint(1, 6))}
        spans = [
            (b - a, a, b)
            for a in range(len(words))
            for b in range(a + 2, len(words) + 1)
            if len(pairs & set(zip(words[a:b], words[a + 1 : b]))) >= L.ALIKE * len(pairs)
        ]
        assert L.stretch(words, pairs) == (min(spans)[1:] if spans else None)


def test_lines_to_learn_from_differ(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of it" for j in range(20))) for i in range(300)], "doc_id long, text string")
    assert len(L.sample_lines(docs)) == 20
    docs = spark.createDataFrame([(i, f"only here {i}\neverywhere") for i in range(5000)], "doc_id long, text string")
    found = L.sample_lines(docs, 200)
    assert len(found) == len(set(found)) == 200
