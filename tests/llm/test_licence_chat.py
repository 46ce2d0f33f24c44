"""Licence scans against the same model in plain Python; preference pairs against plain formatting."""

import random
import re

import numpy as np

from strandex.llm import chat, licence

DOCS = "doc_id long, text string, family string, paragraph string"


def test_scan_against_plain_model(spark):
    model = licence.default_model()
    rnd = random.Random(1)
    lines = [t for ts in licence.TEMPLATES.values() for t in ts] + ["Apache!", "no words of it", "", "the car's licence plate", "mit der Übelicense x", "MIT"]
    texts = ["\n".join(rnd.sample(lines, 5)) for _ in range(40)] + [None, "", "license " * 3000, lines[1], lines[1]]
    rows = [(i % 44, t, "x", "y") for i, t in enumerate(texts)]
    got = sorted(map(tuple, licence.scan(spark.createDataFrame(rows, DOCS)).collect()))
    want = []
    for i, text in [r[:2] for r in rows]:
        for k, line in enumerate(re.split(licence.BREAK, text or "")):
            words = licence._TOKEN.findall(line.lower())
            if licence._ANCHORS.isdisjoint(words):
                continue
            p = model.probabilities(line)
            family = model.classes[p.argmax()] if p.max() >= licence.CONFIDENCE else licence.UNKNOWN
            pairs, best = set(licence._grams(words, 2, 2)), 0.0
            for t in licence.TEMPLATES.get(family, ()):
                own = set(licence._grams(licence._TOKEN.findall(t.lower()), 2, 2))
                few, many = sorted((len(pairs), len(own)))
                best = max(best, len(pairs & own) / max(1, few if len(pairs & own) >= licence.PAIRS else many))
            if family != licence.UNKNOWN:
                want.append((i, k, family, p.max(), best, best >= licence.SIMILARITY))
    assert [(*r[:3], r[5]) for r in got] == [(*r[:3], r[5]) for r in sorted(want)]
    assert np.allclose([r[3:5] for r in got], [r[3:5] for r in sorted(want)], atol=2e-6)
    assert licence.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_templates_are_recognised():
    model = licence.default_model()
    for name, templates in licence.TEMPLATES.items():
        assert model.classes[model.probabilities(templates[0]).argmax()] == name
    for text in ("the house of commons met", "Licensed under the Zlib license", "license plate", "words"):
        assert model.classes[model.probabilities(text).argmax()] == licence.UNKNOWN


MIT = """MIT License

Copyright (c) 2021 J. Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0"""


def test_wrapped_texts_and_titles(spark):
    titles = {"MIT License": "mit", "Apache License": "apache-2.0", "BSD 2-Clause License": "bsd", "Mozilla Public License Version 2.0": "mpl-2.0"}
    texts = [MIT, APACHE, *titles, "Some words of prose.\n" + APACHE]
    got = licence.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).where("confirmed").collect()
    found = {(r.doc_id, r.paragraph, r.family) for r in got}
    assert {(0, 0, "mit"), (0, 2, "mit"), (1, 0, "apache-2.0"), (len(texts) - 1, 1, "apache-2.0")} <= found
    assert {(i + 2, 0, f) for i, f in enumerate(titles.values())} <= found


def test_prose_is_not_a_licence(spark):
    prose = [
        "Er ging mit seinem Hund in den Park und kam mit einem Ball zurück.", "Mit der Zeit wurde es mit allem besser.", "She has a licence to drive and a permission slip.",
        "Il a obtenu la permission de son commons.", "El señor con licencia de conducir.", "The MIT", "under the GPLv3", "He studied at MIT and wrote about the GNU antelope.",
    ]
    got = licence.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(prose)], DOCS)).collect()
    assert not [r for r in got if r.confirmed] and len(got) <= 2  # the two short names are known but not confirmed


def test_preferences(spark):
    u, a = "user", "assistant"
    talks = {
        (1, "chosen"): [(0, "system", "s"), (1, u, "hi"), (2, a, "good")], (1, "rejected"): [(0, "system", "s"), (1, u, "hi"), (2, a, "bad"), (3, u, None)],
        (2, "chosen"): [(0, u, "x"), (1, a, "y")], (2, "rejected"): [(0, u, "x"), (1, a, "y")],
        (3, "chosen"): [(0, u, "only")],
        (4, "chosen"): [(0, u, "x"), (0, u, "x"), (1, a, "<|im_end|>")], (4, "rejected"): [(0, u, "x"), (1, a, "")],
        (5, "chosen"): [(0, u, "x"), (1, None, "y")], (5, "rejected"): [(0, u, "x")],
    }
    rows = [(p, s, t, r, x, "clash") for (p, s), turns in talks.items() for t, r, x in turns] + [(None, "chosen", 0, u, "z", "c")]
    frame = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt string").orderBy("text")
    got = {r.pair_id: r for r in chat.preferences(frame).collect()}
    show = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert set(got) == {1, 2, 3, 4, 5}
    one = got[1]
    assert (one.prefix_turns, one.prompt, one.chosen, one.status) == (2, show("system", "s") + show(u, "hi"), show(a, "good"), "ok")
    assert one.rejected == show(a, "bad") + show(u, "")
    for text, mask, want in ((one.chosen, one.chosen_mask, ["good<|im_end|>"]), (one.rejected, one.rejected_mask, ["bad<|im_end|>"])):
        assert [text[m.start : m.start + m.length] for m in mask] == want
    assert (got[2].status, got[2].chosen, got[3].status, got[3].prompt, got[3].chosen) == ("same", "", "unpaired", "", show(u, "only"))
    assert got[4].prefix_turns == 1 and got[4].chosen == show(u, "x") + show(a, "<| im_end|>") and got[4].status == "ok"
    assert got[5].status == "short" and got[5].chosen == show("unknown", "y") and got[5].rejected == ""
    assert chat.preferences(frame.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(1, s, i, "user" if i % 2 == 0 else "assistant", "w " * 5000 if i < 30 else s) for s in ("chosen", "rejected") for i in range(40)]
    got = chat.preferences(spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string")).first()
    assert got.prefix_turns == 30 and len(got.chosen_mask) == 5


def test_pairs_share_their_first_turns(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "q2"), (0, 3, "assistant", "mine"), (1, 0, "user", "z"), (1, 1, "assistant", "other")]
    rows += [(2, 0, "user", "q"), (5, 0, "assistant", "x"), (-2, 0, "user", "n"), (-2, 1, "assistant", "p"), (-1, 0, "assistant", "r"), (None, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.preferences(chat.answers_of_others(turns)).collect()}
    assert {k: (r.prefix_turns, r.status) for k, r in got.items()} == {0: (3, "ok"), 1: (1, "same"), 2: (0, "unpaired"), -1: (1, "ok")}
    assert "mine" in got[0].chosen and "other" in got[0].rejected and "q2" in got[0].prompt
