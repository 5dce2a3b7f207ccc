"""Licence scans: normalised text against licence templates, Dice coefficient over word bigrams, columns only.

Every line, every paragraph (between blank lines) and the whole of a text is a unit. Units and templates are lower-cased, everything but
letters and digits becomes one space, and their sets of word bigrams are compared: 2 * common / (units + templates).

Dice of at least s bounds the sizes: a unit of n bigrams can match a template of m only if m * s / (2 - s) <= n <= m * (2 - s) / s, so only
templates in these bounds are compared. A match also holds at least m * s / (2 - s) of the template's bigrams; from that follows, for each template,
a small set of anchor words of which a matching unit has at least one. Units without any anchor are passed over before they are taken apart;
both bounds lose no match.

One projection, no shuffle: rows are judged alone, by code generated or interpreted in the JVM; the templates are literals.

Defined cases: null, empty and wordless texts match nothing (no licences, dice 0); a unit of one word has no bigram and matches nothing; at equal Dice the template
listed first wins; repeated rows give repeated results. Extra columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.llm.common import column

DICE = 0.8

# fixed values: notices and short licence texts as they are in public use
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
      deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
      copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
      copyright notice and this permission notice appear in all copies."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
      Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
]


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def least_common(m: int, dice: float) -> int:
    """Bigrams of a template of m that any matching unit holds."""
    return math.ceil(m * dice / (2 - dice) - 1e-9)


def anchors(bigrams: list[str], dice: float) -> list[str]:
    """Long words such that a unit without any of them holds too few of the bigrams."""
    spare, chosen, missed = least_common(len(bigrams), dice), [], list(bigrams)
    for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
        if len(missed) < spare:
            break
        if any(word in b.split() for b in missed):
            chosen.append(word)
            missed = [b for b in missed if word not in b.split()]
    return chosen


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any_anchor(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def unit_bigrams(unit: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = _let(words, lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))))
    return F.coalesce(F.array_distinct(pairs), F.array().cast("array<string>"))


def matches(text: Column, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> Column:
    """array<struct<dice, rank, licence>>: the best template of each unit that matches one."""
    listed, words = [], set()
    for i, (name, body) in enumerate(templates):
        b = template_bigrams(body)
        words.update(anchors(b, dice))
        fields = [F.lit(name).alias("licence"), F.lit(-i).alias("rank"), F.lit(len(b)).alias("m"), F.array(*map(F.lit, b)).alias("b")]
        listed.append(F.struct(*fields))
    known, words = F.array(*listed), sorted(words, key=lambda w: (len(w), w))
    low, high = dice / (2 - dice), (2 - dice) / dice

    def best(unit: Column) -> Column:
        def over(b: Column) -> Column:
            n = F.size(b)
            near = F.filter(known, lambda t: (n >= t.m * F.lit(low) - 1e-9) & (n <= t.m * F.lit(high) + 1e-9))
            scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(b, t.b)) / (n + t.m)).alias("dice"), t["rank"].alias("rank"), t.licence.alias("licence")))
            return F.array_max(F.filter(scored, lambda x: x.dice >= dice))

        return _let(unit_bigrams(unit), over)

    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \\t]*\n"), F.array(text)))
    found = F.transform(F.filter(units, lambda u: _any_anchor(F.lower(u), words)), best)
    return F.when(_any_anchor(F.lower(text), words), F.filter(found, lambda x: x.isNotNull()))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """Per document: doc_id, licences (names found, sorted, comma-joined), n_units (units that match), best_licence, best_dice."""
    found = docs.select(column(doc_id).alias("doc_id"), matches(column(text), templates, dice).alias("found"))
    best = F.array_max("found")
    return found.select(
        "doc_id", F.coalesce(F.array_join(F.array_sort(F.array_distinct("found.licence")), ","), F.lit("")).alias("licences"),
        F.coalesce(F.size("found"), F.lit(0)).cast("bigint").alias("n_units"), best["licence"].alias("best_licence"), F.coalesce(best["dice"], F.lit(0.0)).alias("best_dice"),
    )
