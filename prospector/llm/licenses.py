"""Operator 1, license scans: a trained paragraph classifier, and a comparison with templates that confirms it.

DataFrame functions only over the documents; there is no shuffle. A paragraph (a line) is classified by its sentences that
hold an anchor word (licence, copyright, warranty, ...); a paragraph without any is of the unknown class. Lines between
blank lines are also read joined, as a wrapped paragraph, where a sentence with an anchor word runs over a line break: the
run as a whole and each such sentence; what that confirms is added to what the lines say. Features are the
distinct word n-grams (one to three words) of these sentences; a multinomial logistic regression gives each licence
family and the unknown class a probability. The temperature and the least probability of a family are calibrated on
held-out paragraphs: below it, a paragraph is unknown. A family is confirmed when a template of it is found in the
paragraph, that is, most of the template's word pairs, with none that only another licence's statement has; and not if
terms that only another licence has follow in the next lines (X11, curl and others share whole paragraphs with a family).

The classifier is trained here, on the driver, from the statements below and variations of them: a few thousand
paragraphs, whatever the corpus, so the model is a constant of a few thousand numbers that goes with the plan.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNKNOWN = "unknown"
ANCHORS = r"licen[cs]|copyright|copyleft|spdx|warrant|redistribut|sublicens|permission|public domain|creative ?commons|(?<![a-z0-9])(?:cc[ -]?(?:by|0|zero)|[al]?gpl|(?:gnu|bsd|mpl|apache|mozilla|isc)(?![a-z0-9]))"
SENTENCE = r"(?<=[.!?])[ \t\r]+"
#: Ends of sentences in wrapped lines, and lines that end a paragraph: blank, or nothing but the marks of a comment.
WRAPPED_SENTENCE = r"(?<=[.!?])[ \t\r\n]+"
BLANK = r"^[ \t\r*#/]*$"
WORD = "[a-z0-9]+"
#: Part of a template's word pairs that a paragraph must have to confirm it.
CONFIRMED = 0.75
SEED = 3

#: Names of licences by family.
NAMES = {
    "mit": ["MIT License", "MIT license (MIT)", "Expat License", "MIT"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL v3", "GPL-3.0-or-later", "GPLv2", "GPL", "GNU GPL", "GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 2.1", "GNU LGPL v3", "LGPL-2.1-only", "GNU LGPL", "GNU Lesser General Public License", "GNU Library General Public License, version 2", "GNU Library General Public License"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0-only", "GNU Affero General Public License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause \"Simplified\" License", "BSD-3-Clause"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "Mozilla Public License, version 1.1", "MPL 1.1"],
    "isc": ["ISC License", "ISC license (ISC)"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"],
    "public-domain": ["CC0 1.0 Universal", "CC0-1.0", "Unlicense", "Creative Commons Zero public domain dedication"],
}
#: Sentences of the licences themselves, as their publishers give them.
BODIES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library.", "You should have received a copy of the GNU Library General Public License along with this library."],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "is placed in the public domain", "was released into the public domain", "was released to the public domain", "This file is in the public domain.", "This code is in the public domain.", "This software is in the public domain.", "No copyright is claimed.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights under copyright law"],
}
#: Pairs of words that the statement of another licence has, and a template's paragraph must not have.
FOREIGN = {"mit": ["the materials", "data files", "its documentation", "supporting documentation"], "isc": ["its documentation", "supporting documentation"]}
#: What other licences say in the lines after the statement that they share with a family.
_AND = r"[\s*#/]+"
FOREIGN_TERMS = {
    "mit": ["except as contained in this notice", "including the dates of first publication"],
    "isc": ["except as contained in this notice", "in advertising or publicity pertaining to"],
    "bsd": ["information on how to obtain complete source code", "may not be called"],
}
#: Lines after the first of a statement in which its licence's terms are looked for.
REACH = 40
COMMON_WORDS = {"MIT"}
LEADS = ["under", "license", "identifier", "the"]
NOTICES = ["{}", "{}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is available under the {}; see LICENSE.", "Distributed under the terms of the {}.", "The code is covered by the {}.", "SPDX-License-Identifier: {}", "License: {}", "Published under a {} licence.", "Except where noted, content is under {}.", "Copyright 2020 the authors, {}."]
#: Texts with anchor words that grant no licence of these families.
OTHERS = ["All rights reserved.", "Copyright 2021 Example Inc. All rights reserved.", "Copyright holders keep all rights.", "The driver's license had expired.", "She lost her fishing licence.", "A license plate was found.", "The license fee is due each year.", "Licensed under the Example Vendor Agreement.", "This software is licensed, not sold, under a proprietary license.", "Released under the Acme Source License.", "License: see the vendor.", "Use is subject to a commercial license agreement.", "Permission denied.", "He asked for permission to speak.", "No permission is granted.", "The permission of the owner is needed.", "The warranty lasts two years.", "This warranty does not cover damage by water.", "There is no warranty on used goods.", "Apache helicopters flew over.", "The Apache people live in the southwest.", "Apache Spark runs on a cluster.", "The Apache web server was restarted.", "MIT researchers published a study.", "She studied physics at MIT.", "BSD sockets are used here.", "The BSD kernel boots.", "GNU parallel runs jobs.", "GNU make builds it.", "Mozilla announced a browser.", "The wealth was redistributed among the poor.", "Redistribution of income was debated.", "The licensing board met.", "A licensed doctor signed.", "He licensed the patent.", "Copyright law is complicated.", "Creative commons rooms in the school.", "The painting is no longer under copyright.", "The ISC committee met.", "The general public may enter.", "Many old books are in the public domain.", "The story entered the public domain."]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(text: str) -> list[str]:
    """Distinct n-grams of one to three words of the sentences that hold an anchor word; sentences don't share n-grams."""
    out: dict[str, None] = {}
    for s in re.split(SENTENCE, text):
        if re.search(ANCHORS, s.lower()):
            w = words_of(s)
            for k in (1, 2, 3):
                out.update(dict.fromkeys(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)))
    return list(out)


def foreign_terms(family: str) -> str:
    """Pattern of terms, in lower case, that tell a licence of no family from this one; its words may run over lines and comment marks."""
    return "|".join(_AND.join(t.split(" ")) for t in FOREIGN_TERMS[family])


def _filler(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "ción", "que", "ung", "the", "an", "of", "ré", "ment", "in"]) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n))


def training_rows(rng: random.Random, copies: int) -> list[tuple[str, str]]:
    """(paragraph, family) of statements in varied surroundings; the unknown class also has statements that name no known licence."""
    out = []
    for _ in range(copies):
        for family, names in NAMES.items():
            for name in names:
                for notice in rng.sample(NOTICES, 5):
                    out.append((notice.format(name), family))
            for body in BODIES.get(family, []) * 4:
                w = body.split(" ")
                cut = rng.randrange(max(1, len(w) // 3))
                out.append((" ".join(w[cut:]), family))
        for other in OTHERS * 3:
            out.append((other, UNKNOWN))
        for notice in NOTICES * 3:
            out.append((notice.format(_filler(rng, rng.choice([1, 2, 3])) + rng.choice([" License", "", " Public License", " Agreement", " 1.0"])), UNKNOWN))
    spread = []
    for text, family in out:
        before, after = (_filler(rng, rng.choice([0, 0, 4, 12])) for _ in range(2))
        spread.append((f"{before}{rng.choice([' ', '. ']) if before else ''}{text} {after}".strip(), family))
    return spread


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    least: float


def _probabilities(logits: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def trained() -> Model:
    """The classifier; the same in every process."""
    rng = random.Random(SEED)
    rows = [(grams_of(t), f) for t, f in training_rows(rng, 4)]
    rows = [(g, f) for g, f in rows if g]
    classes = (*sorted(NAMES), UNKNOWN)
    seen: dict[str, int] = {}
    for g, _ in rows:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    vocabulary = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 6))}

    def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, (g, _) in enumerate(rows):
            x[i, [vocabulary[k] for k in g if k in vocabulary]] = 1
        return x, np.array([classes.index(f) for _, f in rows])

    x, y = matrix(rows)
    weight, bias = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    share = 1.0 / np.bincount(y, minlength=len(classes))[y]
    share = (share / share.sum()).astype(np.float32)
    want = np.eye(len(classes), dtype=np.float32)[y]
    velocity = np.zeros_like(weight)
    for _ in range(300):
        gap = (_probabilities(x @ weight + bias, 1.0) - want) * share[:, None]
        velocity = 0.9 * velocity - 1.0 * (x.T @ gap + 1e-4 * weight)
        weight += velocity
        bias -= gap.sum(0)
    weight[np.abs(weight) < 0.02] = 0  # sparse
    held = [(grams_of(t), f) for t, f in training_rows(rng, 2)]
    hx, hy = matrix([r for r in held if r[0]])
    logits = hx @ weight + bias
    temperature = min((0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0), key=lambda t: -np.log(_probabilities(logits, t)[np.arange(len(hy)), hy] + 1e-12).mean())
    p = _probabilities(logits, temperature)
    top = p.argmax(1)
    unknown = classes.index(UNKNOWN)
    wrong = p.max(1)[(top != hy) & (top != unknown)]
    least = float(max(0.5, np.quantile(wrong, 0.99) if len(wrong) else 0.0))
    kept = {g: [round(float(v), 4) for v in weight[i]] for g, i in vocabulary.items() if weight[i].any()}
    return Model(classes, kept, [round(float(b), 4) for b in bias], float(temperature), min(least, 0.95))


def pairs_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({" ".join(w[i : i + 2]) for i in range(len(w) - 1)} or set(w))


def templates() -> dict[str, list[dict]]:
    """Names and sentences of each family; a name that is a common word in some language counts only after one of LEADS."""
    phrases = lambda name: [f"{lead} {name}" for lead in LEADS] if name in COMMON_WORDS else [name]
    return {f: [{"name": t, "pairs": pairs_of(p), "foreign": FOREIGN.get(f, []) if t in BODIES.get(f, []) else []} for t in [*NAMES[f], *BODIES.get(f, [])] for p in phrases(t)] for f in NAMES}


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _grams(w: Column, k: int) -> Column:
    """The runs of k words of w, which must be a lambda variable: any other expression would be computed for each run."""
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))


def _classified(paragraph: Column, model: Model) -> Column:
    """struct(family, probability, confirmed, template) of one paragraph that holds an anchor word."""
    sentences = F.filter(F.split(paragraph, SENTENCE), lambda s: F.lower(s).rlike(ANCHORS))
    split = F.transform(sentences, lambda s: F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)))
    grams = F.array_distinct(F.flatten(F.transform(split, lambda w: F.concat(*[_grams(w, k) for k in (1, 2, 3)]))))
    weights = _constant(model.weights, "map<string,array<double>>")

    def logits(grams: Column) -> Column:
        found = F.filter(F.transform(grams, lambda g: F.try_element_at(weights, g)), lambda w: w.isNotNull())
        return F.aggregate(found, F.array(*map(F.lit, model.bias)), lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))

    classes = F.array(*map(F.lit, model.classes))
    known = _constant(templates(), "map<string,array<struct<name:string,pairs:array<string>,foreign:array<string>>>>")

    def judged(x: Column) -> Column:
        top = F.array_max(x["logits"])
        total = F.aggregate(x["logits"], F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / F.lit(model.temperature)))
        family = F.element_at(classes, F.array_position(x["logits"], top).cast("int"))
        return F.struct(F.when(1 / total >= model.least, family).otherwise(UNKNOWN).alias("family"), (1 / total).alias("probability"), x["grams"].alias("grams"))

    def confirmed(x: Column) -> Column:
        own = F.coalesce(F.try_element_at(known, x["family"]), F.array().cast("array<struct<name:string,pairs:array<string>,foreign:array<string>>>"))
        fits = F.filter(own, lambda t: (F.size(F.array_intersect(t["pairs"], x["grams"])) >= CONFIRMED * F.size(t["pairs"])) & ~F.arrays_overlap(t["foreign"], x["grams"]))
        best = F.array_max(F.transform(fits, lambda t: F.struct(F.size(t["pairs"]).alias("n"), t["name"].alias("name"))))
        return F.struct(x["family"].alias("family"), x["probability"].alias("probability"), best.isNotNull().alias("confirmed"), best["name"].alias("template"))

    # One-element arrays name what is used more than once; it would else be computed for each use.
    scored = F.transform(F.array(grams), lambda g: F.struct(logits(g).alias("logits"), g.alias("grams")))
    return F.transform(F.transform(scored, judged), confirmed)[0]


def _wrapped(lines: Column) -> Column:
    """struct(paragraph, line, first, last) of runs of lines and of their sentences with an anchor word that run over a line break.

    paragraph is where the run begins, first to last are its lines. Runs without such a sentence are left out.
    """
    blanks = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(BLANK), i)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(-1)), blanks, F.array(F.size(lines)))

    def runs(x: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(1), F.size(x["bounds"]) - 1), lambda k: F.struct((F.get(x["bounds"], k - 1) + 1).alias("first"), (F.get(x["bounds"], k) - 1).alias("last")))
        return F.transform(F.filter(ends, lambda e: e["last"] > e["first"]), lambda e: F.struct(e.alias("e"), F.array_join(F.slice(x["lines"], e["first"] + 1, e["last"] - e["first"] + 1), "\n").alias("text")))

    def units(r: Column) -> Column:
        over = F.filter(F.split(r["text"], WRAPPED_SENTENCE), lambda s: F.contains(F.rtrim(s), F.lit("\n")) & F.lower(s).rlike(ANCHORS))
        texts = F.transform(F.array(over), lambda o: F.when(F.size(o) > 0, F.array_distinct(F.concat(F.array(r["text"]), o))).otherwise(F.array().cast("array<string>")))[0]
        return F.transform(texts, lambda u: F.struct(r["e"]["first"].alias("paragraph"), F.translate(u, "\n", " ").alias("line"), r["e"]["first"].alias("first"), r["e"]["last"].alias("last")))

    found = F.transform(F.array(F.struct(lines.alias("lines"), bounds.alias("bounds"))), runs)[0]
    return F.flatten(F.transform(F.filter(found, lambda r: F.lower(r["text"]).rlike(ANCHORS)), units))


MATCH = "array<struct<paragraph:int,family:string,probability:double,confirmed:boolean,template:string>>"


def license_scan(docs: DataFrame, text_col: str = "text", out_col: str = "license_matches") -> DataFrame:
    """docs with out_col: a struct (paragraph, family, probability, confirmed, template) for each line that holds an anchor word,
    and, after these, for each family that is confirmed only by reading the lines between two blank ones joined.

    paragraph is the number of the line, or of the first of the joined lines.

    family is "unknown" where no family reaches the calibrated probability; template is the longest that confirms the
    family. Null or empty text, and text without anchor words: an empty array. Every row is judged on its own, repeated
    ones too; texts are read whole. A column of docs named like out_col is replaced. Empty table: no rows.
    """
    model = trained()
    one = lambda i, line: F.struct(i.alias("paragraph"), line.alias("line"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    read = lambda lines: F.concat(F.filter(F.transform(lines, lambda line, i: one(i, line)), lambda x: F.lower(x["line"]).rlike(ANCHORS)), _wrapped(lines))

    def scanned(x: Column, lines: Column) -> Column:
        near = F.lower(F.array_join(F.slice(lines, x["paragraph"] + 1, REACH + 1), "\n"))
        other = lambda c: F.coalesce(reduce(lambda acc, f: F.when(c["family"] == f, near.rlike(foreign_terms(f))).otherwise(acc), FOREIGN_TERMS, F.lit(False)), F.lit(False))
        named = F.transform(F.array(_classified(x["line"], model)), lambda c: F.struct(c.alias("c"), F.when(c["confirmed"], ~other(c)).otherwise(False).alias("sure")))
        got = F.transform(named, lambda n: F.struct(x["paragraph"].alias("paragraph"), n["c"]["family"].alias("family"), n["c"]["probability"].alias("probability"), n["sure"].alias("confirmed"), F.when(n["sure"], n["c"]["template"]).alias("template"), x["first"].alias("first"), x["last"].alias("last")))
        return got[0]

    def kept(all_: Column) -> Column:
        lines, runs = F.filter(all_, lambda x: x["first"].isNull()), F.filter(all_, lambda x: x["confirmed"] & x["first"].isNotNull())
        both = F.transform(F.array(F.struct(lines.alias("lines"), runs.alias("runs"))), lambda b: F.concat(b["lines"], F.filter(b["runs"], lambda x, i: new(b, x, i))))
        return F.transform(both[0], lambda x: F.struct(*[x[c].alias(c) for c in ("paragraph", "family", "probability", "confirmed", "template")]))

    def new(b: Column, x: Column, i: Column) -> Column:
        """No line of the run, and no reading of it before this one, confirms the family."""
        said = F.exists(b["lines"], lambda y: y["confirmed"] & (y["family"] == x["family"]) & y["paragraph"].between(x["first"], x["last"]))
        return ~said & ~F.exists(F.slice(b["runs"], 1, i), lambda y: (y["first"] == x["first"]) & (y["family"] == x["family"]))

    judged = lambda lines: F.transform(F.array(F.transform(read(lines), lambda x: scanned(x, lines))), kept)[0]
    found = F.transform(F.array(F.split(text_col, "\n")), judged)[0]
    matches = F.when(F.lower(text_col).rlike(ANCHORS), found).otherwise(F.array().cast(MATCH))
    return docs.withColumn(out_col, matches)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the paragraphs with anchor words, those of a known family, those confirmed, the families, and the best match."""
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("license_matches").alias("m"))
    known = F.filter("m", lambda x: x["family"] != UNKNOWN)
    sure = F.filter("m", lambda x: x["confirmed"])
    best = F.array_max(F.transform(sure, lambda x: F.struct(x["probability"].alias("p"), (-x["paragraph"]).alias("at"), x["family"].alias("family"), x["template"].alias("template"))))
    return out.select(
        "doc_id",
        F.size("m").cast("long").alias("n_paragraphs"),
        F.size(known).cast("long").alias("n_known"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        best["family"].alias("family"),
        F.round(best["p"], 6).alias("probability"),
        best["template"].alias("template"),
    )


def brute_force(text: str | None, model: Model | None = None) -> list[tuple]:
    """license_scan's matches of one text, by plain Python; for tests."""
    model = model or trained()
    lines = (text or "").split("\n")

    def judged(paragraph: str, at: int) -> tuple:
        grams = grams_of(paragraph)
        logits = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.bias)))
        p = _probabilities(logits[None], model.temperature)[0]
        family = model.classes[int(p.argmax())] if p.max() >= model.least else UNKNOWN
        fits = [(len(t["pairs"]), t["name"]) for t in templates().get(family, []) if len(set(t["pairs"]) & set(grams)) >= CONFIRMED * len(t["pairs"]) and not set(t["foreign"]) & set(grams)]
        if family in FOREIGN_TERMS and re.search(foreign_terms(family), "\n".join(lines[at : at + REACH + 1]).lower()):
            fits = []
        return family, float(p.max()), bool(fits), max(fits)[1] if fits else None

    out = [(i, *judged(line, i)) for i, line in enumerate(lines) if re.search(ANCHORS, line.lower())]
    alone = {(m[0], m[1]) for m in out if m[3]}
    bounds = [-1, *[i for i, line in enumerate(lines) if re.search(BLANK, line)], len(lines)]
    for first, end in zip([b + 1 for b in bounds], bounds[1:], strict=False):
        run = "\n".join(lines[first:end])
        over = [s for s in re.split(WRAPPED_SENTENCE, run) if "\n" in s.rstrip(" ") and re.search(ANCHORS, s.lower())]
        known = {f for i, f in alone if first <= i < end}
        for unit in dict.fromkeys([run, *over] if over else []):
            got = judged(unit.replace("\n", " "), first)
            if got[2] and got[0] not in known:
                known.add(got[0])
                out.append((first, *got))
    return out
