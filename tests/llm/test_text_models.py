"""Quality, decontamination and extraction against plain models of them, and their odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandex.llm import decontaminate, html, quality

DOCS = "doc_id long, text string, lang string, score string, leaks string"


def words(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) + str(rnd.randrange(90)) for _ in range(n))


# -- quality


def corpus():
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = ". ".join(words(rnd, 12).capitalize() for _ in range(4)) if good else " ".join([words(rnd, 1)] * 30 + [words(rnd, 1)] * 30)
        docs.append((i, text, "en", "x", "y"))
        if i % 2 or i % 8 == 0:
            labels.append((i, int(good), 0))
    return docs, labels


def test_quality_learns_without_held_out_labels(spark):
    docs, labels = corpus()
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(frame, known)
    got = {r.doc_id: r.score for r in quality.score(frame.select("doc_id", "text"), model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in range(600)]) > 0.97
    import zlib

    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    again = quality.train(frame, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.score for r in quality.score(frame.select("doc_id", "text"), again).collect()} == got


def test_quality_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, None), (1, " \n", None, None, None), (2, "é" * 100000, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    model = quality.train(frame, spark.createDataFrame([], "doc_id long, quality int"))
    out = quality.score(frame, model).collect()
    assert len(out) == 4 and all(r.score == 0.5 for r in out)
    assert quality.score(frame.limit(0), model).count() == 0


def test_class_prior_from_positive_and_unlabelled():
    rnd = np.random.default_rng(0)
    p = rnd.normal(3, 1, (4000, 2))
    u = np.vstack([rnd.normal(3, 1, (3500, 2)), rnd.normal(-3, 1, (1500, 2))])
    assert quality.class_prior(p.sum(axis=1), u.sum(axis=1)) == pytest.approx(0.7, abs=0.06)


def test_nonnegative_risk_matches_differences():
    rnd = np.random.default_rng(3)
    f, y = rnd.normal(size=40), (rnd.random(40) < 0.5).astype(float)
    prior = 0.4

    def value(f):
        plus, minus = np.logaddexp(0, -f), np.logaddexp(0, f)
        rest = minus[y == 0].mean() - prior * minus[y == 1].mean()
        return prior * plus[y == 1].mean() + max(0.0, rest)

    g = quality._nonnegative(prior)(f, y)
    for i in range(40):
        d = np.zeros(40)
        d[i] = 1e-6
        assert g[i] == pytest.approx((value(f + d) - value(f - d)) / 2e-6, abs=1e-5)


# -- decontamination


def plain_tiles(item, text, least):
    """Greedy string tiling as it is defined, over all pairs of positions."""
    a, b, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return total
        k, i, j = best
        a[i : i + k], b[j : j + k] = [True] * k, [True] * k
        total += k


def test_tiling_against_its_definition():
    rnd = random.Random(2)
    for _ in range(200):
        vocab = "abcd"[: rnd.choice([2, 4])]
        item = [rnd.choice(vocab) for _ in range(rnd.randint(1, 14))]
        text = [rnd.choice(vocab + "x") for _ in range(rnd.randint(0, 30))]
        if rnd.random() < 0.5:
            text[3:3] = item[len(item) // 2 :] + ["x"] + item[: len(item) // 2]
        index = decontaminate.Index([(7, " ".join(item))], 3)
        want = plain_tiles(item, text, 3) if len(item) >= 3 else len(item) * (text == item)  # a short item has to be the whole text
        got = decontaminate.coverages(" ".join(text), index)
        assert got == [] if not want else abs(got[0][1] - want / len(item)) < 1e-9, (item, text, got, want)


def test_contamination(spark):
    rnd = random.Random(4)
    item = words(rnd, 30).split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Short, item"), (3, ""), (4, None), (5, " ".join(item)), (None, " ".join(item))], "item_id long, text string")
    moved = item[15:] + ["gap"] + item[:15]
    rows = [words(rnd, 50), " ".join(item).upper(), "x " + " ".join(moved) + " y", "a short ITEM.", "short ITEM!", None, "", " ".join(item[:20]), words(rnd, 30000) + " " + " ".join(item)]
    docs = spark.createDataFrame([(i, t, "en", "s", "l") for i, t in enumerate(rows)], DOCS)
    got = {r.doc_id: [x.item_id for x in r.found] for r in decontaminate.contamination(docs, bench, out="found").collect()}
    assert got == {0: [], 1: [None, 1, 5], 2: [None, 1, 5], 3: [], 4: [2], 5: [], 6: [], 7: [], 8: [None, 1, 5]}
    assert decontaminate.contamination(docs, bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_many_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(6)
    items = [(i, words(rnd, 12)) for i in range(12)]
    docs = spark.createDataFrame([(i, f"{words(rnd, 9)} {items[i % 12][1]}", None, None, None) for i in range(24)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {r.doc_id: r.leaks for r in decontaminate.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1)
    monkeypatch.setattr(decontaminate, "BLOCKS", 5)
    assert {r.doc_id: r.leaks for r in decontaminate.contamination(docs, bench).collect()} == one
    assert all(x[0].item_id == i % 12 for i, x in one.items())


# -- extraction


def test_pages(spark):
    article = "<h1>A &lt;title&gt;</h1><p>First  line\nof <b>text</b>ual prose, which goes on and on.<p>Second &amp; last paragraph, it ends here."
    page = f"<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy this now</div><article>{article}</article><footer>Foot text</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<p"), (5, "u", page[: page.index("<footer>")]), (1, "u", page), (7, "u", "<div>" * 4000 + "deep text")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = "A <title> First line of textual prose, which goes on and on. Second & last paragraph, it ends here."
    assert Counter(r.text for r in got if r.page_id in (1, 5)) == Counter({want: 3})
    assert all(r.text == "" for r in got if r.page_id in (2, 3)) and len(got) == 7
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_parser_keeps_all_text_in_order():
    tree = html.parse("a<p>b<i>c</i> d<br>e<ul><li>f<li>g</ul>h<script>no</script>i<!-- no --><table><tr><td>j<td>k</table> &eacute;&amp 1 < 2")
    runs = [html._tidy(r for r, _ in x.runs) for x in html.flatten(tree) if x.tag == "#text"]
    assert runs == ["a", "bc d e", "f", "g", "hi", "j", "k", "é& 1 < 2"]


def test_decoding_is_consistent_and_best():
    rnd = random.Random(8)
    for _ in range(40):
        nodes = [html.Node("#root", "", None)]
        for _ in range(8):
            nodes.append(html.Node("div", "", rnd.choice(nodes)))
        nodes = html.flatten(nodes[0])
        logit = np.array([rnd.gauss(0, 2) for _ in nodes])
        at = {id(x): i for i, x in enumerate(nodes)}
        up = [0] + [at[id(x.parent)] for x in nodes[1:]]
        value = lambda k: sum(-np.logaddexp(0, -z) if b else -np.logaddexp(0, z) for z, b in zip(logit[1:], k[1:]))
        legal = []
        for m in range(256):
            k = [True] + [bool(m >> i & 1) for i in range(8)]
            if all(not k[i] or k[up[i]] for i in range(9)):
                legal.append(k)
        assert html.decode(nodes, logit) == max(legal, key=value)


def test_invented_held_out_pages():
    rnd = random.Random(77)
    model, same = html.default_model(), 0
    for _ in range(150):
        page = html.invent(rnd)
        marked = [x for x in html.flatten(html.parse(page)) if any("\x01" in r for r, _ in x.runs)]
        want = " ".join(html._tidy(r.replace("\x01", "") for r, _ in x.runs) for x in marked)
        same += html.main_texts([page.replace("\x01", "")], model)[0] == re.sub(" +", " ", want).strip()
    assert same >= 135
