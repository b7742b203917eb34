"""Licence notices by a trained paragraph classifier (method of the dealt operator 2).

Built-in DataFrame functions and ``pyspark.ml`` throughout. A sparse logistic regression over word
n-grams, trained here on notices in many wordings and on other prose, gives each paragraph a family
or ``unknown``; the probability a family needs is calibrated on paragraphs not trained on, so that
what is not a notice stays unknown. A found family counts only if the paragraph also shares enough
word pairs with a template of it, those that tell it from its kin among them. SPDX tags count as they
stand.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Share of a template's word pairs that a paragraph has to hold.
CONFIRM = 0.6
#: Words of a scored window: a long paragraph is scored window by window, all of it.
WINDOW, STEP = 60, 30

#: Notices by family. The words that licences ask their users to give.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License 2.0.",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This project is licensed under the terms of the MIT license.",
        "MIT License",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "isc": [
        "Released under the ISC License.",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "bsd-2-clause": [
        "Released under the BSD 2-Clause License.",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "0bsd": [
        "Released under the BSD Zero Clause License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "zlib": [
        "Released under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    ],
    "unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-sa-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "cc-by-nd-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc0-1.0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
    ],
}

#: Word pairs that tell a family from its kin: a template that has one of its family's confirms nothing without it.
TELLS = {
    "apache-2.0": ["apache license", "version 2.0", "license 2.0", "licenses license-2.0"],
    "mit": ["mit license"],
    "gpl-3.0": ["gnu general", "version 3"],
    "gpl-2.0": ["gnu general", "version 2"],
    "lgpl-3.0": ["lesser general", "version 3"],
    "lgpl-2.1": ["lesser general", "version 2.1"],
    "agpl-3.0": ["affero general", "version 3"],
    "isc": ["isc license"],
    "bsd-2-clause": ["bsd 2-clause"],
    "bsd-3-clause": ["bsd 3-clause"],
    "0bsd": ["bsd zero"],
    "zlib": ["zlib license", "commercial applications", "held liable"],
    "unlicense": ["the unlicense", "unencumbered software"],
    "epl-2.0": ["eclipse public", "license 2.0", "v 2.0"],
    "mpl-2.0": ["mozilla public", "version 2.0", "v 2.0"],
    "cc-by-nc-4.0": ["by-nc 4.0", "attribution-noncommercial 4.0"],
    "cc-by-sa-4.0": ["by-sa 4.0", "attribution-sharealike 4.0"],
    "cc-by-nc-sa-4.0": ["by-nc-sa 4.0", "attribution-noncommercial-sharealike 4.0"],
    "cc-by-nd-4.0": ["by-nd 4.0", "attribution-noderivatives 4.0"],
    "cc-by-4.0": ["by 4.0", "attribution 4.0"],
    "cc0-1.0": ["cc0 1.0"],
    "proprietary": ["no part"],
}
#: Texts that hold another family's words whole: where both are found, the words that they share are the latter's.
#: The third clause makes BSD-3 of BSD-2, and the demand to keep the notice makes ISC of 0BSD.
WITHIN = {"bsd-2-clause": "bsd-3-clause", "0bsd": "isc"}
#: Templates of so few pairs are headings: only in a line of few words do they confirm.
HEADING, HEADED = 4, 8
#: Families whose words also stand in the notices of others, as the rights reserved in a copyright line.
SHARED = (*WITHIN, "proprietary")
#: The families' names are SPDX identifiers; a tag names them outright, in so many words after it at most.
TAG, TAGGED = "spdx-license-identifier", 12

#: Prose that is about neither. Own sentences.
PROSE = [
    "The driver needs a license to operate the truck in this state.",
    "She asked for permission to leave the room early.",
    "A copy of the letter was kept in the archive for the public.",
    "The software update fixes a problem with the printer version two.",
    "Under the bridge the water was free of ice and the work went on.",
    "All of the people in the room reserved a seat for the evening.",
    "The mit campus is close to the river and open to any person.",
    "General motors published the terms of the offer this morning.",
    "In the spring the apache helicopter flew over the valley at noon.",
    "The restaurant released a new menu and the guests liked it.",
    "He is a creative person and shares his work with the village.",
    "The foundation gave money to the public library of the city.",
    "Every part of this machine can be replaced without a tool.",
    "The right answer is given at the end of the chapter.",
    "That is all we know of the case and the rights of the owner are in doubt.",
    "This is the story of a house that was in the north of the country.",
    "They of the and in is it was for on are with as at be this from or.",
]


def words(text: Column) -> Column:
    """Lower-case words; a dot or hyphen stays only inside one, as in ``2.0`` and ``by-nc``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))
    return found


def grams(found: Column, longest: int = 3) -> Column:
    """Word n-grams of 1 to ``longest`` words."""
    size = F.size(found)

    def of(n: int) -> Column:
        at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(found, i, n), " "))

    return F.concat(*[of(n) for n in range(1, longest + 1)])


def _paragraphs(spark: SparkSession, sentences: list[str] = PROSE) -> DataFrame:
    """Training paragraphs: templates whole, beginnings and endings of them, among prose, and prose alone."""
    rows = []
    prose = [s.lower().split() for s in sentences]
    for family, notices in TEMPLATES.items():
        for notice in notices:
            own = notice.split()
            least = max(3, min(len(own), round(0.6 * len(own))))
            spans = {tuple(own)} | {tuple(own[:n]) for n in range(least, len(own))} | {tuple(own[-n:]) for n in range(max(least, len(own) - 2), len(own))}
            rows += [(family, " ".join(s)) for s in sorted(spans)]
            for i in range(6):
                before, after = prose[(3 * i + len(own)) % len(prose)], prose[(5 * i + 1) % len(prose)]
                rows.append((family, " ".join([*before[: 2 * i], *own, *after[: 12 - 2 * i]])))
            # a window of a whole text holds a wrapped notice among more words than the notice has
            for i in range(6):
                around = [w for k in range(7) for w in prose[(7 * i + 3 * k + len(own)) % len(prose)]][: max(0, WINDOW - len(own))]
                at = len(around) * i // 5
                rows.append((family, " ".join([*around[:at], *own, *around[at:]])))
    # the same words in another order are no notice
    for family, notices in TEMPLATES.items():
        for notice in notices:
            own = notice.split()
            if len(own) > 5:
                rows.append((UNKNOWN, " ".join(sorted(own))))
                rows.append((UNKNOWN, " ".join(own[::-1])))
    rows += [(UNKNOWN, " ".join(prose[i][a:] + prose[(i + k) % len(prose)])) for i in range(len(prose)) for k in (1, 2, 4, 7) for a in (0, 3)]
    long = [" ".join([w for k in range(7) for w in prose[(i + step * k) % len(prose)]][:WINDOW]) for i in range(len(prose)) for step in (2, 3, 5)]
    rows += [(UNKNOWN, text) for text in long] + [(UNKNOWN, "")] * 5
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(rows)], "i int, family string, text string")


def _pairs(notice: str) -> list[str]:
    """Word pairs of a template, as ``words`` and ``grams`` see them."""
    own = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", notice.lower())
    return sorted({f"{a} {b}" for a, b in zip(own, own[1:])})


def anchors(confirm: float = CONFIRM) -> list[str]:
    """Words without which no paragraph can hold the share of any template that confirms it.

    Per template the longest words are taken until the pairs that hold none of them are too few.
    """
    chosen: list[str] = []
    for notice in (n for notices in TEMPLATES.values() for n in notices):
        pairs = [p.split() for p in _pairs(notice)]
        own = sorted({w for p in pairs for w in p}, key=lambda w: (-len(w), w))
        left = lambda: [p for p in pairs if not any(c in w for w in p for c in chosen)]  # noqa: B023, E731
        for word in own:
            if len(left()) < confirm * len(pairs):
                break
            if any(word in p for p in left()):
                chosen.append(word)
    # a word that holds another anchor adds nothing
    return sorted(c for c in set(chosen) if not any(o != c and o in c for o in chosen))


class Classifier:
    """Vocabulary, weights, and the calibrated probability below which a paragraph is unknown."""

    def __init__(self, spark: SparkSession):
        self.families = [UNKNOWN, *TEMPLATES]
        place = F.create_map(*[x for i, f in enumerate(self.families) for x in (F.lit(f), F.lit(float(i)))])
        learner = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.5, family="multinomial")

        def counted(sentences: list[str]) -> DataFrame:
            rows = _paragraphs(spark, sentences).withColumn("grams", grams(words(F.col("text"))))
            return rows.withColumn("label", place[F.col("family")])

        def fitted(rows: DataFrame):
            vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2).fit(rows)
            return vocabulary, learner.fit(vocabulary.transform(rows).select("label", "features"))

        # whole sentences are kept out of the first fit, not other cuttings of those it has seen
        vocabulary, first = fitted(counted([s for i, s in enumerate(PROSE) if i % 3]))
        kept = vocabulary.transform(counted([s for i, s in enumerate(PROSE) if not i % 3]))
        self.needed = self._calibrated(first.transform(kept))
        self.vocabulary, self.model = fitted(counted(PROSE))

    @staticmethod
    def _calibrated(tried: DataFrame) -> float:
        """Halfway from the surest wrong family of the paragraphs kept back to certainty; one half at least."""
        p = vector_to_array("probability")
        surest = F.array_max(F.transform(F.slice(p, 2, len(TEMPLATES)), lambda own: own / (own + p[0])))
        wrong = tried.agg(F.max(F.when(F.col("label") == 0, surest))).first()[0] or 0.0
        return max(0.5, min(0.9, (1 + wrong) / 2))

    def classify(self, windows: DataFrame) -> DataFrame:
        """A row with ``family``, ``probability``, ``overlap`` and ``named`` for each family confirmed in a row of ``windows``.

        ``windows`` has an array of ``found`` words and a ``paragraph``, null for a window of a whole
        text. Each family is held against unknown alone, so one window may hold several. ``named`` is
        false where nothing but words that other families' notices hold as well speaks for a family.
        """
        rows = self.model.transform(self.vocabulary.transform(windows.withColumn("grams", grams(F.col("found")))))
        after = F.slice("found", F.array_position("found", TAG).cast("int") + 1, F.lit(TAGGED))
        tagged = F.when(F.col("paragraph").isNotNull() & F.array_contains("found", TAG), after).otherwise(F.array().cast("array<string>"))
        rows = rows.select(*windows.columns, "grams", vector_to_array("probability").alias("p"), tagged.alias("tagged"))
        places = [(f, F.col("p")[i] / (F.col("p")[i] + F.col("p")[0])) for i, f in enumerate(self.families) if f != UNKNOWN]

        def share(family: str, notice: str) -> Column:
            pairs = _pairs(notice)
            tells = [F.array_contains("grams", t) for t in TELLS.get(family, []) if t in pairs]
            overlap = F.size(F.array_intersect("grams", F.array(*map(F.lit, pairs)))) / len(pairs)
            if len(pairs) < HEADING:
                tells = [*tells, F.col("paragraph").isNotNull() & (F.size("found") <= HEADED)]
            return F.when(reduce(lambda a, b: a & b, tells, F.lit(True)), overlap).otherwise(0.0)

        def confirmed(family: str, own: Column) -> Column:
            overlap = F.greatest(*[share(family, n) for n in TEMPLATES[family]], F.lit(0.0))
            named = F.arrays_overlap("tagged", F.array(*[F.lit(family + end) for end in ("", "-only", "-or-later")]))
            one = F.lit(1.0)
            told = F.arrays_overlap("grams", F.array(*map(F.lit, TELLS[family]))) | named if family in SHARED else F.lit(True)
            of = lambda p, o: F.struct(F.lit(family).alias("family"), p.alias("probability"), o.alias("overlap"), told.alias("named"))
            return F.when(named, of(one, one)).when(own >= self.needed, of(own, overlap))

        # by a generator, so that a filter on its columns does not compute them again
        every = F.filter(F.array(*[confirmed(f, own) for f, own in places]), lambda x: x["overlap"] >= CONFIRM)
        return rows.select(*windows.columns, F.inline(every))


def notices(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Confirmed notices: ``doc_id, mark, paragraph, window, family, probability, overlap, named, text``.

    Paragraphs are the lines of a text, from 0, and, where there are several lines, the whole text
    with line feeds as blanks (``paragraph`` is null), as notices are often wrapped. One of more than
    ``WINDOW`` words is looked at in overlapping windows, all of it. Paragraphs and windows without an
    anchor could not be confirmed, so they are not scored.
    """
    classifier = classifier or Classifier(docs.sparkSession)
    # through an array of one, so that the text is made once and not once for each anchor
    holds = lambda text: F.exists(F.array(text), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in anchors()]))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where(F.col("text").isNotNull() & holds(F.lower("text")))
    lines = F.transform(F.split("text", r"\n"), lambda line, i: F.struct(i.alias("paragraph"), line.alias("text")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("paragraph"), F.col("text").alias("text")))
    rows = rows.select("doc_id", "mark", F.inline(F.when(F.contains("text", F.lit("\n")), F.concat(lines, whole)).otherwise(lines)))
    rows = rows.where(holds(F.lower("text"))).withColumn("all", words(F.col("text")))
    last = F.greatest(F.lit(0), F.ceil((F.size("all") - WINDOW) / STEP)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda w: F.struct(w.alias("window"), F.slice("all", w * STEP + 1, F.lit(WINDOW)).alias("found")))
    text = F.when(F.col("paragraph").isNotNull(), F.col("text")).alias("text")
    rows = rows.select("doc_id", "mark", "paragraph", text, F.inline(cut)).where(holds(F.array_join("found", " ")))
    rows = rows.withColumn("text", F.coalesce("text", F.array_join("found", " ")))
    return classifier.classify(rows).drop("found")


def _by_family(found: DataFrame) -> DataFrame:
    """Notices of a document by family; those in shared words go to the family that the rest of it tells, or to none."""
    each = found.groupBy("doc_id", "mark", "family", "named").agg(
        F.collect_set("paragraph").alias("lines"),
        F.collect_set(F.when(F.col("paragraph").isNull(), F.col("window"))).alias("at"),
        F.max(F.struct("probability", "overlap")).alias("surest"),
        F.max("probability").alias("probability"),
        F.max("overlap").alias("overlap"),
    )
    # at most two rows for each family
    document = Window.partitionBy("doc_id", "mark")
    each = each.withColumns(
        {
            "__all": F.collect_set("family").over(document),
            "__named": F.collect_set(F.when(F.col("named"), F.col("family"))).over(document),
        }
    )
    own = F.col("family")
    unnamed = ~F.array_contains("__named", own)
    family = own
    for inner, outer in WITHIN.items():
        family = F.when((own == inner) & unnamed & F.array_contains("__all", outer), F.lit(outer)).otherwise(family)
    formality = (own == "proprietary") & unnamed & (F.size("__all") > 1)
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return each.where(~formality).withColumn("family", family).groupBy("doc_id", "mark", "family").agg(
        F.size(gathered("lines")).alias("lines"),
        F.sort_array(gathered("at")).alias("at"),
        F.max("surest").alias("surest"),
        F.max("probability").alias("probability"),
        F.max("overlap").alias("overlap"),
    )


def licences(docs: DataFrame) -> DataFrame:
    """``doc_id, license, families, notices, probability, overlap`` for each row of ``docs``.

    ``license`` is the family of the surest confirmed notice (ties by name), or ``unknown``;
    ``families`` lists all found, sorted, joined by commas. ``notices`` adds up over the families the
    lines that are notices or, if these are more, the places of the whole text that hold one. Words
    that a BSD-2 text shares with BSD-3, or 0BSD with ISC, count for the longer one where a document
    has both and does not name the shorter; rights reserved beside another licence count for nothing.
    Null,
    empty and blank texts are unknown with no notices and probability and overlap 0. Repeated rows
    stay repeated. Other columns are not read; no rows give no rows.
    """
    found = _by_family(notices(docs))
    # windows that follow each other overlap: one place
    places = F.size(F.filter("at", lambda w, i: F.coalesce(w - F.get("at", i - 1) > 1, F.lit(True))))
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(
        F.max_by("family", F.struct("surest", "family")).alias("license"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
        F.sum(F.greatest("lines", places)).alias("notices"),
        F.max("probability").alias("probability"),
        F.max("overlap").alias("overlap"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    return rows.select(
        "doc_id",
        F.coalesce("license", F.lit(UNKNOWN)).alias("license"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("notices", F.lit(0)).alias("notices"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
    )
