import random

from pedalgrid.llm import license_scan as L


def model():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + "the of and to a in is this that all for copy software use".split()
    return L.train([" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(4, 30))) for _ in range(600)])


def test_lines_that_are_no_literal_templates():
    m = model()
    for line in (
        "All rights reserved.",
        "Copyright (c) 2024 Acme Inc. All rights reserved.",
        "Copyright (C) 1998-2007 Jane Doe and others",
        "Copyright 2011 Acme Inc.",
    ):
        found = m.scan(f"w1 w2 w3 w4\n{line}\nw5 the w6")
        assert [f for f, _ in found] == ["all-rights-reserved"], line
    for line in ("Copyright law is old", "all the rights of the w7 are reserved", "in 2024 w3 w4"):
        assert m.scan(line) == [], line


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_wrapped_texts_are_found():
    m = model()
    for family, text in (("mit", MIT), ("bsd", BSD), ("gpl-3.0", GPL)):
        for mark in ("", " * ", "# ", "// ", "dnl "):
            wrapped = "\n".join(mark + x for x in text.split("\n"))
            for whole in (wrapped, f"w1 w2\n{mark}\n{wrapped}\n{mark}\nw3 w4 the", f"/*\n{wrapped}\n */\nw5 w6"):
                assert [f for f, _ in m.scan(whole)] == [family], whole
    # a blank line parts blocks
    assert m.scan(BSD.replace("without\n", "without\n\n").replace("are\n", "are\n\n")) == []


def test_a_line_counts_once():
    assert [f for f, _ in model().scan("w1 w2\nReleased under the MIT License\nw3 w4")] == ["mit"]


def test_a_notice_gives_way_to_a_licence(spark):
    text = "Copyright (c) 2024 Acme Inc. All rights reserved.\n\nReleased under the MIT License"
    docs = spark.createDataFrame([(1, text), (2, "All rights reserved.")], "doc_id long, text string")
    assert {r["doc_id"]: r["licence"] for r in L.scan(docs, model()).collect()} == {1: "mit", 2: "all-rights-reserved"}
