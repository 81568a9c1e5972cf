from docloom.llm import license_scan as ls

from . import cases


def brute(text):
    w = cases.words(text)
    at, labels = [], set()
    for phrase, label in ls.BASE:
        p = phrase.split(" ")
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    "Licensed under CC-BY 4.0. cc by cc by", "All rights\nreserved. all rights reserved", "the GNU General Public License, General public license",
    "all rights", "cc", "by cc", ls.LICENCES[0].text + " " + "filler " * 50, "intro words " + ls.LICENCES[2].text.upper(),
    "apache license", "permission is hereby granted", None, "", "ÀLL rights reserved", "x" * 3000,
]


def test_base_matches_brute_force(spark):
    docs = cases.frame(spark, TEXTS + cases.texts())
    got = ls.scan(docs).collect()
    assert sorted((r.id, r.n_words, r.n_base, r.first_word or -1, r.last_word or -1, ",".join(r.base_labels)) for r in got) == sorted(
        (r.doc_id, *((x if x is not None else -1) if k in (2, 3) and (x or -1) else x for k, x in enumerate(brute(r.text)[:2] + tuple(v or -1 for v in brute(r.text)[2:4]) + brute(r.text)[4:]))) for r in docs.collect()
    )
    assert all(0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels) for r in got)


def test_method_adds_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(100 + i, f"some other text {i} entirely") for i in range(60)], "doc_id long, text string")
    got = {r.id: r for r in ls.scan(docs).collect()}
    assert got[6].labels == ["mit"] and got[6].score > 0.9
    assert got[7].labels == ["bsd"]
    assert got[9].labels == [] and got[110].score == 0
    assert ls.scan(docs.limit(0)).count() == 0


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": ["apache-2.0"], "Released under the MIT License.": ["mit"],
    "This work is licensed under the GNU General Public License, version 3.": ["gpl"], "Licensed under CC BY-NC 4.0.": ["cc-by"],
    "Distributed under the Mozilla Public License, v. 2.0": ["mpl-2.0"], "the apache wrote a license": [],
}


def test_licence_lines_of_documents(spark):
    lines = list(NOTICES)
    rows = [(i, f"some text {i} before\n{lines[i % len(lines)]}\nand words after") for i in range(60)] + [(100 + i, f"other text {i}") for i in range(200)]
    got = {r.id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(60):
        assert got[i].labels == NOTICES[lines[i % len(lines)]] and got[i].score == float(bool(got[i].labels))


PLAIN = tuple(ls.Licence(x.label, x.text, x.key_phrases) for x in ls.LICENCES)  # passages only


def test_every_licence_of_a_file_is_aligned(spark):
    texts = [" ".join(x.text for x in PLAIN), PLAIN[0].text + " and " + PLAIN[1].text, "any copy code use " * 300 + PLAIN[2].text]
    rows = list(enumerate(texts)) + [(100 + i, f"header {i} {PLAIN[1].text}") for i in range(80)] + [(300 + i, f"other {i}") for i in range(40)]
    got = {r.id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences=PLAIN).collect()}
    assert got[0].labels == sorted(x.label for x in PLAIN)
    assert got[1].labels == ["apache-2.0", "mit"] and got[1].best_score > 0.99
    assert got[2].labels == ["bsd"]
    assert all(got[100 + i].labels == ["apache-2.0"] and got[100 + i].score > 0.99 for i in range(80))  # two thirds of the files
    assert got[300].labels == []


def test_a_phrase_needs_its_neighbours_and_a_passage_its_phrase(spark):
    w = ls._words(PLAIN[0].text)
    cut = [x for i, x in enumerate(w) if not 2 <= i <= 3]  # half of the key phrase is gone
    texts = [
        "permission is hereby granted free of charge for this and that", "free and unencumbered software", "redistribution and use in source and binary forms is fine",
        " ".join(w[:40]), " ".join(["begin"] * 7 + w[:9] + ["x", "y"] + w[11:]), " ".join(cut), " ".join(reversed(w)),
    ]
    rows = list(enumerate(texts)) + [(10 + i, f"some other text {i} entirely, of the software and so on") for i in range(60)]
    got = {r.id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(7)] == [[], [], [], ["mit"], ["mit"], [], []]
    assert 0 < got[0].best_score < ls.ACCEPT and 0.5 < got[3].score < 1 and 0.9 < got[4].score < 1


def brute_alignment(text, weight, known):
    """Labels and best score by every template at every relative position."""
    f, labels, best = cases.words(text), set(), 0.0
    for t in known:
        whole = sum(weight[x] for x in t.words)
        for s in range(-len(t.words) + 1, len(f)):
            at = [i for i, x in enumerate(t.words) if 0 <= i + s < len(f) and f[i + s] == x]
            score = min(1.0, sum(weight[t.words[i]] for i in at) / whole)
            if score >= t.least - 1e-9 and t.key <= set(at):
                labels.add(t.label)
                best = max(best, score)
    return labels, best


def test_look_ups_find_what_all_positions_do(spark):
    import random

    rng = random.Random(8)
    passages = [ls._words(x.text) for x in ls.LICENCES] + [n.split() for x in ls.LICENCES for n in x.notices]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = list(rng.choice(passages))
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                p[rng.randrange(len(p))] = rng.choice(["the", "of", "software", "license", "zzz"])
            parts += p[: rng.choice([len(p), len(p) // 2 + 1])] + [rng.choice(["and", "the", "copy"])] * rng.randrange(5)
        texts.append(" ".join(parts))
    docs = cases.frame(spark, texts + cases.texts()[:40])
    weight = ls.weights(docs.select(ls.words_col(docs["text"]).alias("words")))
    known = ls.templates()
    for r, text in [(r, texts[r.id]) for r in ls.scan(docs).collect() if r.id < 150 and r.id != 3]:
        labels, best = brute_alignment(text, weight, known)
        assert set(r.labels) == labels | set(r.base_labels), text
        assert abs(r.score - (1.0 if r.n_base else best)) < 1e-9
