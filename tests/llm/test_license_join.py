"""Blocks leave it to the join whether a template is held."""

import random
import re

from mirrorcheck.llm import licenses


def test_the_join_decides_which_blocks_hold_a_template(spark):
    apart = "released " + "x " * 200 + "under " + "x " * 200 + "the mit license"
    near = "Released under the MIT License"
    docs = spark.createDataFrame([(1, apart), (2, near), (3, None)], "doc_id long, text string")
    sets = {n: licenses.template_words(t) for n, t in licenses.TEMPLATES}
    lengths = {n: licenses.window_length(t, 0.8) for n, t in licenses.TEMPLATES}
    made = licenses.blocks(docs, licenses.PHRASES, sets, 0.8, lengths)
    assert {r.doc_id: len(r.blocks) for r in made.collect()} == {1: 1, 2: 1, 3: 0}
    found = {r.doc_id: r.labels for r in licenses.license_table(docs).collect()}
    assert found == {1: "mit", 2: "mit,mit-notice", 3: ""}


def test_every_block_of_a_text_is_joined(spark):
    rng = random.Random(10)
    templates = [("a", "w1 w2 w3 w4 w5 w1"), ("b", "w3 w4 w5 w6 w7 w8"), ("c", "w9 w2 w1 w7"), ("d", "w4")]
    twice = "Released under the MIT License " + "x " * 30 + "released, under\nthe MIT license"
    texts = [" ".join(rng.choice(["x", *(f"w{k}" for k in range(1, 10))]) for _ in range(rng.randrange(60))) for _ in range(40)]
    for some, given in ((licenses.TEMPLATES, [twice, "the license", "", None]), (templates, [*texts, "w4", "x " * 50 + texts[0]])):
        docs = spark.createDataFrame([*enumerate(given)], "doc_id long, text string")
        sets = {n: licenses.template_words(t) for n, t in some}
        lengths = {n: licenses.window_length(t, 0.8) for n, t in some}
        rows = licenses.blocks(docs, licenses.PHRASES, sets, 0.8, lengths)
        doc = {r.row: r.doc_id for r in rows.collect()}
        made = licenses.containment_join(spark, licenses.windows(rows), sets, 0.8, lengths).collect()
        found = sorted((doc[r.row], at, r.template, r.overlap) for r in made for at in range(r.block, r.last + 1))
        held = []
        for i, text in enumerate(given):
            words = re.findall("[0-9a-z]+", (text or "").lower())
            for n, ws in sets.items():
                c = [len({*words[at:at + lengths[n]]} & {*ws}) for at in range(len(words))]
                held += [(i, at, n, k) for at, k in enumerate(c) if k >= licenses.needed(len(ws), 0.8)]
        assert found == sorted(held)
        if some is licenses.TEMPLATES:
            assert {at for _, at, *_ in found} == {0, 1, 32, 33, 34, 35, 36}


def test_phrases_may_overlap(spark):
    docs = spark.createDataFrame([(1, "the Apache license version of a a a"), (2, None)], "doc_id long, text string")
    phrases = [("apache license", "p"), ("license version", "q"), ("license", "r"), ("a a", "s")]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_table(docs, phrases, []).collect()}
    assert got == {1: (5, 1, 6, "p,q,r,s"), 2: (0, None, None, "")}


def test_templates_may_share_a_name(spark):
    docs = spark.createDataFrame([(1, "free to use by all"), (2, "no right is kept"), (3, "other")], "doc_id long, text string")
    templates = [("my own", "Free to use by all"), ("my own", "No right is kept")]
    assert {r.doc_id: (r.labels, r.score) for r in licenses.license_table(docs, templates=templates).collect()} == {1: ("my own", 1.0), 2: ("my own", 1.0), 3: ("", 0.0)}
