"""Licences of files: TF-IDF cosine against templates, then inheritance from the nearest licensed directory.

Every line of a file, every run of a few lines without a blank one between them, and the whole of a licence file, is a
sparse vector of term counts times inverse document frequencies; frequencies of the templates' terms are counted
over all files, other terms count as the rarest. Only templates that agree in what tells licences
apart are compared: names, kinds of Creative Commons, clauses of BSD, and versions. The best
of them at or above the threshold names the licence, unless one of another licence comes near it. A file without a licence of its own takes
that of the nearest directory above it that holds a licence file.

Lines that cannot reach the threshold are skipped without loss: the terms that a line may share
with a template and still stay below it are known from the weights, and a line with no
other term of any template is not scored.

Whole licence texts are known by their titles and opening sentences; of BSD texts, the clauses that follow count.

Defined results: a licence that no template states, a family without its version and several licences named at
once are left unnamed; "only" and "or later" are one licence; null or empty text has no licence; a null path is a file that neither gives
nor takes a licence; of several licence files in one directory the best score counts, then the
name first in the alphabet; rows that repeat are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.tables import pick, stage

THRESHOLD = 0.6
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
_TERM = re.compile(r"[a-z0-9]+(?:[.][0-9]+)*")

# Lines that are scored together, and the lead that the best licence needs over the next one.
RUN_LINES = 8
LEAD = 0.02

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License"
# GNU licences: name, words, short name, version, what stands behind the version in the title.
_GNU = [
    ("GPL-2.0", "General Public License", "GPL", "2", "June 1991"), ("GPL-3.0", "General Public License", "GPL", "3", "29 June 2007"),
    ("LGPL-2.0", "Library General Public License", "LGPL", "2", "June 1991"),
    ("LGPL-2.1", "Lesser General Public License", "LGPL", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General Public License", "LGPL", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero General Public License", "AGPL", "3", "19 November 2007"),
]
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

# Notices, titles and opening sentences of common licences (public texts; fixed values).
TEMPLATES = {
    "0BSD": ["Licensed under the Zero-Clause BSD License.", _FEE + "."],
    "Apache-1.1": ["The Apache Software License, Version 1.1", "Licensed under the Apache Software License, Version 1.1."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
    ],
    "Artistic-2.0": ["The Artistic License 2.0", "Licensed under the Artistic License 2.0."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License", _BSD],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", _BSD],
    "BSD-4-Clause": ["Licensed under the BSD 4-Clause License.", "BSD 4-Clause License", _BSD],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "CC0-1.0": ["This work is released under CC0 1.0 Universal.", "Creative Commons CC0 1.0 Universal"],
    "EPL-1.0": ["Licensed under the Eclipse Public License, Version 1.0.", "Eclipse Public License - v 1.0"],
    "EPL-2.0": ["Licensed under the Eclipse Public License, Version 2.0.", "Eclipse Public License - v 2.0"],
    "ISC": ["Released under the ISC License.", "ISC License", _FEE + ", provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1", "Mozilla Public License Version 1.1"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
    ],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "WTFPL": ["Licensed under the WTFPL."],
    "Zlib": [
        "Released under the zlib License.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
}
for _name, _words, _short, _version, _date in _GNU:
    TEMPLATES[_name] = [
        f"This work is licensed under the GNU {_words}, version {_version}.",
        f"Licensed under {_short} {_version}.",
        f"GNU {_words} Version {_version}, {_date}",
        _FREE.format(_words, _version),
    ]
for _kind, _words in _CC.items():
    for _version, _scope in _CC_VERSIONS.items():
        TEMPLATES[f"CC-{_kind}-{_version}"] = [
            f"This work is licensed under a Creative Commons {_words} {_version} {_scope} License.",
            f"Licensed under CC {_kind} {_version}.",
            f"Creative Commons {_words} {_version} {_scope}",
        ]
TEMPLATES = {name: [*notices, f"SPDX-License-Identifier: {name}"] for name, notices in sorted(TEMPLATES.items())}

# What tells licences apart (fixed values); "_" is any run of other characters than letters and digits.
_MARKS = {
    "agpl": "affero(?:_general_public)?|agpl", "lgpl": "(?:lesser|library)_general_public|lgpl", "gpl": "general_public_licen[sc]e|gpl",
    "mit": "(?-i:MIT)(?![a-z0-9])|mit_licen[sc]e|expat_licen[sc]e", "apache": "apache", "0bsd": "0bsd|zero_clause_bsd",
    "bsd": "(?:free)?bsd", "mpl": "mozilla_public|mpl", "epl": "eclipse_public|epl(?![a-z])", "isc": "(?-i:ISC)(?![a-z0-9])|isc_licen[sc]e",
    "unlicense": "unlicense", "unencumbered": "free_and_unencumbered", "zlib": "zlib", "held": "held_liable_for_any_damages_arising_from_the_use_of_this_software",
    "boost": "boost_software|bsl(?![a-z])", "cc0": "cc0", "cc": "creative_commons|cc(?=_by(?![a-z]))", "wtfpl": "wtfpl|what_the_fuck_you_want_to_public",
    "artistic": "artistic_licen[sc]e|artistic_2", "grant": "hereby_granted_free_of_charge", "redistribution": "redistribution_and_use_in_source",
    "fee": "with_or_without_fee", "provided": "provided_that_the_above_copyright", "other": "proprietary|eupl|cddl|ms_pl|openssl|free_documentation|gfdl|open_font|psf_licen[sc]e",
}
# A text without any of these words, MIT and ISC holds no name of a notice; they are looked for first, since that is quick.
_SIGNS = tuple(
    "affero gpl general licen expat apache bsd mozilla mpl eclipse epl unencumbered zlib liable boost bsl cc0 creative cc wtfpl public artistic "
    "hereby redistribution without zero".split()
)
_CC_KINDS = {"nc": "nc|non_?commercial", "sa": "sa|share_?alike", "nd": "nd|no_?deriv[a-z]*"}
_CLAUSES = {"2c": "2_clause|two_clause|simplified|freebsd", "3c": "3_clause|three_clause|new_bsd|modified_bsd|revised", "4c": "4_clause|four_clause|original"}


def _pattern(kinds: dict[str, str]) -> re.Pattern:
    parts = (f"(?P<m_{k}>{v})".replace("_?", "[^a-z0-9]*") for k, v in kinds.items())
    body = "|".join(re.sub(r"(?<!\(\?P<m)_", "[^a-z0-9]+", part) for part in parts)
    return re.compile(rf"(?<![a-z0-9])(?:{body})", re.I | re.A)


_MARK, _KIND, _CLAUSE = _pattern(_MARKS), _pattern(_CC_KINDS), _pattern(_CLAUSES)
_VERSION = re.compile(
    r"(?:version|licen[sc]e|gpl|mpl|epl|bsl|cc0|apache|artistic|universal|attribution|commercial|alike|deriv[a-z]*|(?<![a-z])(?:by|nc|sa|nd|v))"
    r"[\s,_().-]*v?[\s.]*([0-9]+(?:[.][0-9]+)*)", re.I
)
_ENDORSE = re.compile(r"neither[^a-z0-9]+the[^a-z0-9]+names?|names?[^.]{0,200}(?:not[^a-z0-9]+be[^a-z0-9]+used|endorse)", re.I)
_ADVERTISE = re.compile(r"all[^a-z0-9]+advertising[^a-z0-9]+materials", re.I)
_BINARY = re.compile(r"redistributions[^a-z0-9]+in[^a-z0-9]+binary[^a-z0-9]+form", re.I)
_FRINGE = re.compile(r"^[\s/*#;%!<>|\"'-]+|[\s/*#;%!<>|\"'-]+$")


def _found(pattern: re.Pattern, text: str) -> set[str]:
    return {m.lastgroup[2:] for m in pattern.finditer(text)}


def marks(text: str, clauses: str | None = None) -> tuple[frozenset[str], frozenset[str]]:
    """(names, kinds and clauses; versions) that a text states. ``clauses`` is what a BSD text goes on to say."""
    names = _found(_MARK, text)
    if "cc" in names:
        names |= _found(_KIND, text)
    if "bsd" in names:
        names |= _found(_CLAUSE, text)
    if "redistribution" in names and clauses:
        names.add(clauses)
    if "cc0" in names:
        names.discard("cc")
    return frozenset(names), frozenset(re.sub(r"([.]0)+$", "", v) for v in _VERSION.findall(text)) if names else frozenset()


def clauses_of(text: str) -> str | None:
    """The number of clauses of the BSD text that a file holds; None if it holds none of them."""
    if not _BINARY.search(text):
        return None
    return "4c" if _ADVERTISE.search(text) else "3c" if _ENDORSE.search(text) else "2c"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def vocabulary(templates: dict[str, list[str]]) -> list[str]:
    return sorted({t for notices in templates.values() for notice in notices for t in terms(notice)})


class Matcher:
    """Best template of a text by the cosine of TF-IDF vectors."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[str, int], n_files: int, threshold: float):
        self.threshold = threshold
        self.rarest = math.log(1 + n_files) + 1
        self.idf = {t: math.log((1 + n_files) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary(templates)}
        self.notices = []
        # names -> (licence, vector, versions)
        self.by_names: dict[frozenset[str], list[tuple[str, dict[str, float], frozenset[str]]]] = {}
        for name in sorted(templates):
            for notice in templates[name]:
                weights = {t: n * self.idf[t] for t, n in Counter(terms(notice)).items()}
                length = math.sqrt(sum(w * w for w in weights.values()))
                self.notices.append((name, {t: w / length for t, w in weights.items()}))
                clauses = next(iter(_found(_CLAUSE, name)), None)
                stated = marks(notice, clauses)
                self.by_names.setdefault(stated[0], []).append((*self.notices[-1], stated[1]))
        self.keys = self._keys()
        self.has_key = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(self.keys, key=len, reverse=True))) + ")")

    def _keys(self) -> set[str]:
        """All terms but the commonest ones, which alone cannot lift any cosine to the threshold."""
        spare = [0.0] * len(self.notices)
        keys = set(self.idf)
        for term in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            with_it = [s + notice.get(term, 0.0) ** 2 for s, (_, notice) in zip(spare, self.notices, strict=True)]
            # cosine <= length of the notice's part made of these terms
            if max(with_it) >= (self.threshold * 0.999) ** 2:
                break
            spare = with_it
            keys.discard(term)
        return keys

    def best(self, text: str, clauses: str | None = None) -> tuple[float, str | None]:
        names, versions = marks(text, clauses)
        notices = self.by_names.get(names)
        if notices is None:
            return 0.0, None
        counts = Counter(terms(text))
        if self.keys.isdisjoint(counts):
            return 0.0, None
        weights = {t: n * self.idf.get(t, self.rarest) for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        scores: dict[str, float] = {}
        for name, notice, stated in notices:
            if stated <= versions:
                scores[name] = max(scores.get(name, 0.0), sum(weights.get(t, 0.0) * w for t, w in notice.items()) / length)
        (score, name), *others = sorted(((x, n) for n, x in scores.items()), reverse=True) or [(0.0, "")]
        if score < self.threshold or (others and others[0][0] > score - LEAD):
            return 0.0, None
        return score, name

    def _may(self, text: str) -> bool:
        """Whether the text can hold a notice: names, unless some notice has none, and a term that is not common."""
        low = text.lower()
        if frozenset() not in self.by_names:
            if not (any(sign in low for sign in _SIGNS) or "MIT" in text or "ISC" in text) or not _MARK.search(text):
                return False
        return self.has_key.search(low) is not None

    def _runs(self, lines: list[str]) -> Iterator[str]:
        """Runs of 2 to RUN_LINES lines that hold a line with a name and no blank one, without the marks of comments.

        A name may be cut by the end of its line, so two lines are looked at together.
        """
        bare = [_FRINGE.sub("", line) for line in lines]
        pairs = [" ".join(bare[i : i + 2]) if all(bare[i : i + 2]) else "" for i in range(len(bare) - 1)]
        named = [i for i, pair in enumerate(pairs) if pair and _MARK.search(pair)]
        starts = sorted({k for i in named for k in range(max(0, i - RUN_LINES + 2), i + 1)})
        last = 0
        for start in starts:
            while last < len(named) and named[last] < start:
                last += 1
            for end in range(named[last] + 2, min(start + RUN_LINES, len(bare)) + 1):
                if not all(bare[start:end]):
                    break
                yield " ".join(bare[start:end])

    def scan(self, text: str, whole: bool) -> tuple[float, str | None]:
        """The best licence of any line or run of lines, and of the whole text if it is a licence file's."""
        if not self._may(text):
            return 0.0, None
        lines = text.split("\n")
        clauses = clauses_of(text)
        found = [self.best(line, clauses) for line in lines if self._may(line)]
        found += [self.best(run, clauses) for run in self._runs(lines)]
        found += [self.best(text, clauses)] if whole else []
        return max((f for f in found if f[1]), key=lambda s: (round(s[0], 9), [-ord(c) for c in s[1]]), default=(0.0, None))


def file_frequencies(files: DataFrame, words: list[str], text: str = "text") -> tuple[dict[str, int], int]:
    """(number of files that hold each of the given terms, number of files)."""
    known = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column("text"):
                counts.update(known.intersection(terms(value.as_py() or "")))
            counts[""] += len(batch)
        yield pa.record_batch({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    found = pick(files, text=text).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # one row per template term
    counts = {r["term"]: r["n"] for r in found.collect()}
    return counts, counts.pop("", 0)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _above(folder: Column) -> Column:
    """The folder and all above it, the root as the empty text."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(
    files: DataFrame,
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    file_id: str = "file_id",
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """(file_id, path, own_license, own_score, inherited_license, inherited_from, license), one row per file."""
    frequency, n_files = file_frequencies(files, vocabulary(templates), text)
    source = pick(files, file_id=file_id, path=path, text=text)
    source = source.withColumn("is_license_file", F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_NAMES), F.lit(False)))
    id_type = source.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, frequency, n_files, threshold)
        for batch in batches:
            found = [
                matcher.scan(t.as_py() or "", whole.as_py())
                for t, whole in zip(batch.column("text"), batch.column("is_license_file"), strict=True)
            ]
            yield pa.record_batch(
                {
                    "file_id": batch.column("file_id"),
                    "path": batch.column("path"),
                    "is_license_file": batch.column("is_license_file"),
                    "own_license": pa.array([name for _, name in found], pa.string()),
                    "own_score": pa.array([round(score, 6) for score, _ in found], pa.float64()),
                }
            )

    scanned = source.mapInArrow(
        run, f"file_id {id_type}, path string, is_license_file boolean, own_license string, own_score double"
    )
    # written once: three uses follow, and the matching of texts is all the work
    scanned = stage(scanned).withColumn("folder", _folder(F.col("path")))
    licensed = scanned.where("is_license_file AND own_license IS NOT NULL").groupBy("folder")
    licensed = licensed.agg(F.min(F.struct(F.negate("own_score").alias("order"), "own_license")).alias("best"))
    licensed = licensed.select(F.col("folder").alias("above"), F.col("best.own_license").alias("inherited_license"))
    folders = scanned.where("path IS NOT NULL").select("folder").distinct()
    nearest = folders.select("folder", F.explode(_above(F.col("folder"))).alias("above")).join(licensed, "above")
    nearest = nearest.groupBy("folder").agg(F.max_by(F.struct("above", "inherited_license"), F.length("above")).alias("near"))
    joined = scanned.join(nearest, "folder", "left")
    takes = F.col("own_license").isNull()
    return joined.select(
        "file_id",
        "path",
        "own_license",
        "own_score",
        F.when(takes, F.col("near.inherited_license")).alias("inherited_license"),
        F.when(takes, F.col("near.above")).alias("inherited_from"),
        F.coalesce("own_license", "near.inherited_license").alias("license"),
    )


# The tree that the query derives: folders of SHELVES[0] neighbouring ids, each of them in one of SHELVES[1] ids, and so on.
# The first document of a folder is its licence file, of the widest folder that it is first of.
SHELVES = (16, 64, 256)


def tree_of(documents: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents laid out as files that share folders; source and language are in their names."""
    docs = pick(documents, doc_id="doc_id", lang="lang", source="source", text="text")
    folder, path = None, None
    for size in reversed(SHELVES):
        part = F.floor(F.col("doc_id") / size).cast("string")
        folder = part if folder is None else F.concat_ws("/", folder, part)
        first = F.when(F.col("doc_id") % size == 0, F.concat(folder, F.lit("/LICENSE")))
        path = first if path is None else F.coalesce(path, first)
    name = F.concat_ws("-", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    # a null id has no folder, and so no path
    return docs.select("doc_id", F.coalesce(path, F.concat(folder, F.lit("/"), name, F.lit(".txt"))).alias("path"), "text").withColumn(
        "path", F.when(F.col("doc_id").isNotNull(), F.col("path"))
    )


def license_query(documents: DataFrame) -> DataFrame:
    """(doc_id, path, own_license, own_score, inherited_license, inherited_from, license) of every document as a file."""
    return scan_licenses(tree_of(documents), file_id="doc_id").withColumnRenamed("file_id", "doc_id")
