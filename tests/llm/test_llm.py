"""The training-data operators against brute force, and on nulls, empty and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from demandloom.llm import ann, bpe, decontaminate, html_extract, line_dedup, minhash, quality, substring_dedup, warc
from demandloom.llm import license as licenses
from demandloom.llm.components import connected_components
from demandloom.llm.queries import ENTRIES, RANKS

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h1 int, bands string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]


def frame(spark, texts):
    """Documents with extra columns whose names clash with internal ones; one null id at the end."""
    rows = [(i, t, "en", "s", 1, "x", 1, "b") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "stray line of a text\n", None, None, None, None, None, None)], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


ODD = [None, "", "\n\n", " ", "one", "one", "ÀÉ İ ß 你好", "a" * 5000, "\t\x0b x \r\n" * 30]


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in "documents embeddings pages benchmark".split():
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    got, expected = ENTRIES[name].run(spark, SF_DIR).toPandas(), duck.sql(ENTRIES[name].sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns) and len(got) == len(expected)
    rows = [sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist())) for f in (got, expected)]
    same = sum(a == b for a, b in zip(*rows, strict=True))
    assert same == len(got) or _close(got, expected, columns)


def _close(got, expected, columns):
    a, b = (f[columns].sort_values(columns, ignore_index=True) for f in (got, expected))
    return all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in columns)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(700)]
    rows += [(700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (None, [1.0] * 24), (760, [1.0] * 3), (761, [2.0] * 3)]
    rows += [(780, rows[0][1]), (781, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = ann.nearest_query(df).collect()
    usable = {i: np.array(v) for i, v in rows if i is not None and v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in (i for i in usable if i % 20 == 0):
        scores = sorted((-float(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:20]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert len(mine) == len(scores)
        hits += len({i for _, i in scores} & {i for _, i in mine})
        total += len(scores)
    assert hits / total >= 0.99
    assert ann.nearest_query(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_queries_and_candidates(spark):
    rng = np.random.default_rng(6)
    ids = [20, 20, 7, 7, 40, *range(100, 160)]
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in zip(ids, rng.normal(size=(len(ids), 16)))]
    data.append(data[2])  # the same row twice
    got = ann.nearest_query(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    expected = []
    for n, (query, v) in enumerate(data):
        if query % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(data) if m != n)[: ann.K]
            expected += [(query, rank, i) for rank, (_, i) in enumerate(scored, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(expected)
    assert sum(r.query_id == 20 for r in got) == 2 * ann.K


@pytest.fixture(scope="module")
def codecs():
    raw = open(RANKS, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.codec(raw, public_tokenizers.PATTERN), theirs


def test_bpe_equals_library(spark, codecs):
    own, theirs = codecs
    rng = random.Random(3)
    texts = [t or "" for t in ODD]
    texts += ["".join(rng.choice("abcde  eeth ßéñ你!#\n012") for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["".join(rng.choice("theinger") for _ in range(3000)), "ab" * 4000, " " * 3000, "!" * 3000 + "?"]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == theirs.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    got = by_id(bpe.bpe_digest(frame(spark, ODD), RANKS, public_tokenizers.PATTERN))
    for i, text in enumerate(ODD):
        ids = theirs.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("long", [bpe.LONG, 1000])
def test_bpe_of_long_pieces_and_no_rows(spark, codecs, long, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", long)
    own, theirs = codecs
    rng = random.Random(4)
    runs = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    text = runs + " " + " ".join(prose(5, bpe.PIECES))
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text) and own.decode(ids) == text.encode()
    assert max(map(len, own._pieces)) <= bpe.REMEMBERED
    twice = spark.createDataFrame([(1, "same row"), (1, "same row"), (1, "else")], "doc_id long, text string")
    got = bpe.bpe_digest(twice, RANKS, public_tokenizers.PATTERN)
    assert sorted(r.n_tokens for r in got.collect()) == sorted(len(theirs.encode_ordinary(t)) for t in ("same row", "same row", "else"))
    assert bpe.bpe_digest(twice.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    scores = by_id(quality.quality_scores(docs, labels))
    known = by_id(labels)
    held = [(scores[i]["score"], r["quality"]) for i, r in known.items() if scores[i]["held_out"]]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    odd = by_id(quality.quality_scores(frame(spark, ODD), labels.limit(0)))
    assert len(odd) == len(ODD) + 1 and all(r["score"] == pytest.approx(0.5) for r in odd.values())
    x = np.random.default_rng(1).standard_normal((4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, n_pairs=1)
    assert model.pairs == [(0, 1)] and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_quality_learns_one_row_per_repeated_id(spark):
    learnt = [r["doc_id"] for r in spark.range(200).select(F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("h")).where("NOT h").collect()]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(learnt[:40])], "doc_id long, quality int")
    texts = [(i, "Good prose, with words in a row." if k % 2 else "# $ % 1 2 3 !") for k, i in enumerate(learnt[:40])]
    hot = [(learnt[0], f"# $ % {n} !") for n in range(300)]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    repeated = spark.createDataFrame(texts + hot, "doc_id long, text string")
    for bound in (40, 30):
        x, y = quality.training_rows(repeated, labels, max_rows=bound)
        assert len(x) == len(y) == bound and y.sum() == quality.training_rows(plain, labels, max_rows=bound)[1].sum() > 0
    scores = by_id(quality.quality_scores(repeated, labels, max_rows=40).dropDuplicates(["doc_id"]))
    assert {i: r["predicted"] for i, r in scores.items()} == {i: k % 2 for k, i in enumerate(learnt[:40])}


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "plain words of a file"),
        (3, "a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (4, "z/y.py", "first line\nLicensed under the Apache License, Version 2.0.\nmore"),
        (5, "z/w.py", None),
        (6, None, ""),
        (7, "a/q.py", "a text about the general public and a version of the work"),
    ]
    df = spark.createDataFrame(rows, "file_id long, path string, text string").withColumn("folder", F.lit("clash"))
    got = by_id(licenses.scan_licenses(df), "file_id")
    assert {i: r["license"] for i, r in got.items()} == {1: "MIT", 2: "GPL-3.0", 3: "GPL-3.0", 4: "Apache-2.0", 5: None, 6: None, 7: "MIT"}
    assert got[2]["inherited_from"] == "a/b" and got[7]["inherited_from"] == "a"
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    # the prefilter loses nothing
    matcher = licenses.Matcher(licenses.TEMPLATES, {"the": 900, "license": 3}, 1000, 0.6)
    whole = licenses.Matcher(licenses.TEMPLATES, {"the": 900, "license": 3}, 1000, 0.6)
    whole.keys = set(whole.idf)
    rng = random.Random(2)
    for _ in range(500):
        line = " ".join(rng.choice([*whole.idf, "word"]) for _ in range(rng.randrange(1, 9)))
        assert matcher.best(line) == whole.best(line)


def test_documents_inherit_from_their_folder_and_from_above(spark):
    """On the given table, against a walk up the folders of every file."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = licenses.license_query(docs).collect()
    assert len(rows) == docs.count()
    held: dict = {}
    for r in rows:
        if r.path.endswith("/LICENSE") and r.own_license:
            assert held.setdefault(r.path[: -len("/LICENSE")], r.own_license) == r.own_license
    same = above = 0
    for r in rows:
        folder, expected = r.path.rsplit("/", 1)[0], (None, None)
        while r.own_license is None and expected[0] is None and folder:
            expected = (held.get(folder), folder) if folder in held else (None, None)
            same += folder in held and folder.count("/") == 2
            above += folder in held and folder.count("/") < 2
            folder = folder.rpartition("/")[0]
        assert (r.inherited_license, r.inherited_from) == expected and r.license == (r.own_license or expected[0])
    assert same >= 100 and above >= 200


def test_licenses_agree_in_what_tells_them_apart():
    common = {t: 300 for t in "the this of to and in for or with is by work under".split()} | {"license": 200, "licensed": 150, "mit": 150}
    matcher = licenses.Matcher(licenses.TEMPLATES, common, 1000, licenses.THRESHOLD)
    cases = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1",
        "SPDX-License-Identifier: ISC": "ISC",
        "SPDX-License-Identifier: Unlicense": "Unlicense",
        "Released under the Unlicense.": "Unlicense",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
        "Released under the Proprietary License.": None,
        "Released under the Other License.": None,
        "This work is licensed under the GNU General Public License, version 4.": None,
        "Licensed under the Apache License.": None,
        "SPDX-License-Identifier: MIT OR Apache-2.0": None,
        "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n Copyright (C) 1989": "GPL-2.0",
        "# Licensed under the Apache\n# License, Version 2.0 (the \"License\"); you may\n# not use this file except in compliance\n# with the License.": "Apache-2.0",
        " * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General\n * Public License as published by the Free Software Foundation;\n"
        " * either version 2.1 of the License, or any later version.": "LGPL-2.1",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files": "MIT",
    }
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    two = "1. Redistributions of source code must retain the above notice.\n\n2. Redistributions in binary form must reproduce the above notice.\n\n"
    cases |= {bsd: None, bsd + two: "BSD-2-Clause", bsd + two + "3. Neither the name of the holder nor the names of others may be used.": "BSD-3-Clause"}
    assert {text: matcher.scan(text, False)[1] for text in cases} == cases
    # every template is named as its licence, as far as one licence alone states it
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            assert matcher._may(notice)
            assert matcher.best(notice, name[4].replace("-", "") + "c" if "Clause" in name else None)[1] == name, notice


def brute_cut(weights, edges):
    def cost(labels):
        wrong = sum(w if not keep else 0 for w, keep in zip(weights, labels, strict=True) if w > 0)
        wrong += sum(-w for w, keep in zip(weights, labels, strict=True) if w < 0 and keep)
        return wrong + sum(c for a, b, c in edges if labels[a] != labels[b])

    return cost, min(cost([bool(m >> i & 1) for i in range(len(weights))]) for m in range(1 << len(weights)))


def test_main_text(spark):
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        weights = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in combinations(range(n), 2) if rng.random() < 0.5]
        cost, least = brute_cut(weights, edges)
        assert cost(html_extract.min_cut(weights, edges)) == pytest.approx(least)
    page = (
        "<html><body><header><h1>Site</h1></header><nav><a href=x>Home page of this site</a></nav>"
        "<article><h1>Title &amp; more</h1><p>First  line\nof <b>the</b> text, with words.<p>Second &#x41;&eacute;.</article>"
        "<aside>Related stories to read next, many of them.</aside><div class='comments'><p>I like it a lot, thanks.</p></div>"
        "<form>Your name</form><script>var a='<p>no</p>'</script><footer>&copy; All rights.</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p"), (None, "x", "<nav>only a menu</nav>")]
    got = by_id(html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[1]["text"] == "Title & more\nFirst line of the text, with words.\nSecond Aé."
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[3]["text"] == got[None]["text"] == ""


def test_main_text_with_stray_quotes():
    text = "A first sentence of the article, long enough to be read as text."
    tags = ['<p class="a"">', "<p title=it's>", '<p "x>', "<p ' class=a>", '<p class=a"b title="c > d">', "<p ='>", '<p a = "b"c"d">']
    for tag in tags:
        page = f"<article>{tag}{text}</p><p>It's the \"second\" one.</p></article>"
        assert html_extract.main_text(page) == f"{text}\nIt's the \"second\" one.", tag
    linked = f"<article><p>{text}</p><p>{text} <a href=/it's>One link</a> and more.</p></article>"
    assert html_extract.main_text(linked) == f"{text}\n{text} One link and more."
    # names of attributes count, not their like inside other names and values
    assert html_extract.main_text(f"<div data-id=search title='class=ad' data-x=/hidden/id><p>{text}</p></div>") == text
    assert html_extract.main_text("<p class='ad") == ""


def test_main_text_in_wrappers_with_boilerplate_words():
    text = [f"Sentence {i} of the article goes on for some words, and then it ends here." for i in range(4)]
    ad = "<div class=ad>Buy this thing now, it is the best thing of all.</div>"
    menu = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
    body = f"<h1>Title</h1><p>{text[0]}</p>{ad}<p>{text[1]}</p><p>{text[2]}</p><p>{text[3]}</p>"
    wanted = "\n".join(["Title", *text])
    for name in ["class=content-sidebar-wrap", "class=has-sidebar", "class='post tag-social'", "class='site header-fixed'", "id=search-page"]:
        for inner in ["%s", "<article>%s</article>", "<main>%s</main>", "<div class=entry-content>%s</div>"]:
            page = f"<body><div {name}>{menu}{inner % body}</div><div class=footer-links>{menu}All rights are with us.</div>"
            assert html_extract.main_text(page) == wanted, (name, inner)
    # article and content words count against a word further out, also where little text is in it
    others = "".join(f"<p>{t}</p>" for t in text)
    for inner in ["<article>%s</article>", "<div class=story>%s</div>"]:
        page = f"<div>{others}{others}</div><div class=has-sidebar>{inner % others}</div>"
        assert html_extract.main_text(page) == "\n".join(text * 3)
    # a part of the page with such a word still goes, within an article as well
    for part in ["<div class=comments>%s</div>", "<div class=widget><p>%s</p></div>", "<p class=share>%s</p>"]:
        page = f"<article>{body}{part % text[0]}</article>"
        assert html_extract.main_text(page) == wanted, part


def test_line_dedup(spark):
    texts = [*ODD, "Hello shared line\nkeep", "x\n  hello SHARED line \nhello shared line", "Ünly shared ÉLINE", "ünly shared Éline"]
    texts += [f"one very common line\nown line of number {i}" for i in range(200)]
    got = by_id(line_dedup.dedup_lines(frame(spark, texts)))
    seen: dict[str, int] = {}
    lower = str.maketrans(line_dedup.ASCII_UPPER if hasattr(line_dedup, "ASCII_UPPER") else "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in enumerate(texts):
        kept = []
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(lower)
            if len(key) < 10 or seen.setdefault(key, i) == i:
                kept.append(line)
        assert got[i]["kept_text"] == "\n".join(kept)
    assert line_dedup.dedup_lines(frame(spark, texts).limit(0)).count() == 0


def shingle_counts(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def brute_similarity(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def test_near_duplicates(spark):
    base, texts = prose(1, 120), list(ODD)
    for k in range(40):
        words, rng = list(base), random.Random(k)
        for at in rng.sample(range(120), k // 4):
            words[at] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(words))
    texts += [" ".join(prose(7, 60)), " ".join(prose(7, 60)).upper(), " ".join(prose(8, 40) * 2), " ".join(prose(8, 40) * 2 + ["end"])]
    got = by_id(minhash.near_duplicates(frame(spark, texts)))
    sets = [shingle_counts(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and brute_similarity(sets[a], sets[b]) >= 0.8 - 1e-12:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert got[None]["class_id"] is None and len(got) == len(texts) + 1
    assert minhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


ALIKE, OTHER = " ".join(prose(21, 60)), " ".join(prose(22, 60))
REPEATED = [(5, ALIKE), (5, OTHER), (9, OTHER), (11, ALIKE), (11, ALIKE), (12, "lone words"), (12, "lone words"), (13, None), (None, OTHER), (None, "")]


def test_near_duplicates_of_rows_that_repeat_an_id(spark):
    found = minhash.near_duplicates(spark.createDataFrame(REPEATED, "doc_id long, text string")).collect()
    expected = [(5, 5, 1, True), (5, 5, 1, True), (9, 5, 1, False), (11, 5, 2, False), (12, 12, 2, True), (13, 13, 1, True)]
    expected += [(None, 5, 1, False), (None, None, 1, True)]
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.class_id, r.n_rows, r.kept)) for r in found)
    unknown = spark.createDataFrame([(None, ALIKE), (None, ALIKE + " more")], "doc_id long, text string")
    assert sorted((r.class_id, r.kept) for r in minhash.near_duplicates(unknown).collect()) == [(None, False), (None, True)]


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in REPEATED], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()
    expected = [(5, ALIKE), (5, OTHER), (12, "lone words"), (13, None), (None, "")]
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.text)) for r in left)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF_DIR).count() == 0


def test_probability_jaccard_of_weighted_sets():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (Counter(rng.integers(0, 12, 30).tolist()) for _ in range(2))
        arrays = [(np.array(sorted(c)), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        assert minhash.probability_jaccard(*arrays) == pytest.approx(brute_similarity(a, b))


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (1, 1), (4, 5), (None, 3)], "a long, b long")
    groups: dict = {}
    for r in connected_components(links).collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 7, 8, 9], [4, 5]]


@pytest.mark.parametrize("hot_anchor", [1000, 3, 0])
def test_passages(spark, hot_anchor):
    shared, texts = prose(2, 50), list(ODD)
    texts += [" ".join(prose(k, 30) + shared[: 34 + k % 3] + prose(k + 90, 20)) for k in range(6)]
    texts += ["again " * 80, " ".join(shared[:35]), "p q " * 20 + "\t" + " ".join(prose(50, 40)), " ".join(prose(60, 40)), " ".join(prose(60, 40))]
    texts += [" ".join(shared) + " x " + " ".join(shared), " ".join(shared)]  # repeated by one text, and held by others
    got = by_id(substring_dedup.dedup_passages(frame(spark, texts), hot_anchor=hot_anchor))
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for i, w in enumerate(words):
        gone = {k for s in range(len(w) - 34) if counts[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        assert got[i]["kept_text"] == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i]["n_removed"] == len(gone) and got[i]["n_words"] == len(w)
    assert substring_dedup.dedup_passages(frame(spark, texts).limit(0)).count() == 0


def test_windows_are_exchanged_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = substring_dedup.passage_digest(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = [line.split("hashpartitioning")[0] for line in plan if re.search(r"Exchange.*hashpartitioning\(h1#\w+, h2#\w+, salt", line)]
    assert [("Reused" in line) for line in found] == [False, True, True]


def test_contamination(spark):
    item, short = prose(30, 14), ["quite", "short"]
    bench = spark.createDataFrame(
        [(10, " ".join(item)), (9, " ".join(item[:10])), (3, " ".join(short)), (4, ""), (5, None)], "item_id long, text string"
    )
    texts = [*ODD, " ".join(prose(1, 9) + item + prose(2, 5)), " ".join(item[1:10]), "Quite, SHORT! quite short", " ".join(item[2:13]).upper()]
    got = by_id(decontaminate.contamination(frame(spark, texts), bench))
    n = len(ODD)
    assert [got[i]["n_hit"] for i in range(n, n + 4)] == [14, 0, 4, 11]
    assert [got[i]["n_items"] for i in range(n, n + 4)] == [2, 0, 1, 1]
    assert got[n]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest()
    assert not any(got[i]["contaminated"] for i in range(n))
    assert decontaminate.contamination(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x/?utm_source=q#f", 10, True, "v1", None, {"ETag": "v1", "Content-Type": "text/html", "Date": "d1"}),
        (2, "https://A.org:443/x", 20, False, 'W/v1', None, {"Date": "d2", "Content-Type": "none"}),
        (3, "a.org/x", 30, True, "v2", None, None),
        (4, "a.org/x", 30, False, "v1", None, None),
        (5, "a.org/x", 40, False, "v1", None, None),
        (6, "a.org/y", 50, False, "v1", None, None),
        (7, "a.org/x", 60, False, None, None, None),
        (8, None, 60, False, "v1", None, None),
        (9, "a.org/x", None, False, "v2", None, None),
    ]
    schema = "record_id long, url string, captured_at long, is_full boolean, etag string, last_modified string, headers map<string,string>"
    df = spark.createDataFrame(rows, schema).withColumn("t", F.lit("clash"))
    got = by_id(warc.resolve_revisits(df, time_blocks=3), "record_id")
    assert {i: (r["status"], r["response_id"]) for i, r in got.items()} == {
        1: ("full", 1), 2: ("resolved", 1), 3: ("full", 3), 4: ("resolved", 1), 5: ("changed", None), 6: ("orphan", None),
        7: ("unchecked", 3), 8: ("orphan", None), 9: ("orphan", None),
    }
    assert [(h["name"], h["value"]) for h in got[2]["headers"]] == [("content-type", "text/html"), ("date", "d2"), ("etag", "v1")]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "double", "decimal(20,6)"])
def test_revisits_within_a_second(spark, kind):
    rows = [(1, "100.100000", True), (2, "100.900000", False), (3, "100.900000", True), (4, "100.900001", False), (5, "100.1", False), (6, "100.9", True)]
    tags = {1: "v1", 2: "v1", 3: "v2", 4: "v3", 5: "v1", 6: "v3"}
    data = [(i, "a.org/x", at, full, tags[i], None, None) for i, at, full in rows]
    schema = "record_id long, url string, captured_at string, is_full boolean, etag string, last_modified string, headers map<string,string>"
    at = F.col("captured_at").cast("decimal(20,6)")
    df = spark.createDataFrame(data, schema).withColumn("captured_at", at)
    df = df.withColumn("captured_at", F.timestamp_micros((at * 1_000_000).cast("long")).cast(kind) if "time" in kind else at.cast(kind))
    got = by_id(warc.resolve_revisits(df), "record_id")
    # of two full responses at one time the larger record counts
    assert {i: (got[i]["status"], got[i]["response_id"]) for i in (2, 4, 5)} == {2: ("resolved", 1), 4: ("resolved", 6), 5: ("orphan", None)}


def test_revisits_by_date_where_there_is_no_tag(spark):
    rows = [(1, 1, True, None, "mon"), (2, 2, False, None, "mon"), (3, 3, False, None, "tue"), (4, 4, False, "t", "mon"), (2, 2, False, None, "mon")]
    schema = "record_id long, url string, captured_at long, is_full boolean, etag string, last_modified string, headers map<string,string>"
    df = spark.createDataFrame([(i, "a.org", at, full, tag, date, None) for i, at, full, tag, date in rows], schema)
    got = warc.resolve_revisits(df).collect()
    assert sorted((r.record_id, r.status) for r in got) == [(1, "full"), (2, "resolved"), (2, "resolved"), (3, "changed"), (4, "resolved")]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF_DIR)
        assert sorted(out.columns) == sorted(docs.columns), name
        left = spark.createDataFrame(out.toPandas(), docs.schema) if not out.isEmpty() else out
    final = by_id(corpus_pipeline.run(spark, SF_DIR))
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert set(final) == set(texts) and 0 < len(final) < docs.count()
    assert all(final[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())
