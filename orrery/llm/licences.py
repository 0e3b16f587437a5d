"""Licence scans by a trained paragraph classifier, on DataFrame functions alone.

A paragraph is what blank lines part, so wrapped notices are whole. Candidates
are the paragraphs that share a word 3-gram with a notice: no other can be
confirmed, so the test loses nothing. Their word 1- to 3-grams are
the sparse features of a multinomial logistic regression over licence families
and an `unknown` class, trained here on the notices below, on pieces of them
and on lines that only sound alike. A prediction counts if its probability
passes the cut, chosen on kept-back pieces so that as many as possible fall on
their side of it, and if one notice of that family
confirms it: by the share of the paragraph's word 3-grams that the notice
holds, or by the share of the notice's 3-grams found close together in the
paragraph. For the latter each stretch that holds enough of a notice is
classified by itself, so a notice counts whatever stands around it in its
paragraph, and one may name several families. A document's family is that of
its surest confirmed paragraph, ties to the first by code point.

Distinct paragraphs are classified once, however many documents repeat them;
every text is scanned whole. Null or empty text has no paragraph and no family;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Short notices by which works name their licence.
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "Released under the AGPL version 3 or later."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0.", "This software is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", "Distributed under the Apache License 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Released under the terms of the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "Except where otherwise noted, content is available under the Creative Commons Attribution License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright to this work under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation.", "Distributed under the GPL version 2 or later.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Released under the GNU General Public License.", "Licensed under the terms of the GNU GPL."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the terms of the LGPL version 3 or later.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the Software without restriction.", "SPDX-License-Identifier: MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "This project is licensed under the terms of the MIT license."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without prior written permission of the copyright owner.", "Proprietary and confidential: unauthorized copying of this file is prohibited by its license.", "All rights reserved.", "Copyright by the authors. All rights reserved."],
}
# Lines that share words with notices and name no licence.
SOUNDALIKES = [
    "He lost his driving license on the way to the station.", "The public was free to use the source of the river.", "The terms of the contract were published in general form.",
    "Permission to enter the foundation was granted without charge.", "The minister issued a license to sell fish.", "Copyright law was discussed at the meeting.",
    "The museum is open to the public under the new version of the rules.", "The software was free and the library small.", "They may not use this road except in spring.",
    "A person with a license for boats.", "The file was released in version two.", "Apache helicopters flew over the town under cover.", "The creative work of the commons was shared.",
    "This work is about the general of the army.", "License plates are made of metal.", "An international license exam was held.", "The bird was released under the tree.",
]
# Notices in full length, as works carry them; templates only, the classifier is trained on the short ones.
FULL = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."],
    "apache": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."],
    "mit": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
UNKNOWN = "unknown"
ORDER = 3
#: Share of a paragraph's word 3-grams (or shorter, if it has none) that must occur in one notice of the family,
#: or share of one notice's that must occur within twice its length in the paragraph.
CONFIRM = 0.5


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(ws: list[str]) -> list[str]:
    return [" ".join(ws[i : i + n]) for n in range(1, ORDER + 1) for i in range(len(ws) - n + 1)]


@lru_cache(1)
def train(seed: int = 3, rounds: int = 400, rate: float = 2.0) -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """(classes, weights by feature, biases, cut): softmax regression by gradient descent."""
    rng = random.Random(seed)
    classes = [*sorted(NOTICES), UNKNOWN]
    rows: list[tuple[list[str], int, bool]] = []
    for k, c in enumerate(classes[:-1]):
        for notice in NOTICES[c]:
            ws = tokens(notice)
            rows += [(ws, k, False)] * 3
            for i in range(6):  # notices amid other words; every third is kept back
                noise = rng.sample([w for s in SOUNDALIKES for w in tokens(s)], 3)
                rows.append((noise[: i % 3] + ws + noise[i % 3 :], k, i % 3 == 2))
    for i, s in enumerate(SOUNDALIKES):
        rows += [(tokens(s), len(classes) - 1, i % 3 == 2)] * 2
    rows += [([w], len(classes) - 1, False) for w in ("license", "licensed", "copyright", "public", "work", "software", "free", "the", "under", "released", "permission")]
    names = sorted({g for ws, _, back in rows if not back for g in grams(ws)})
    at = {g: i for i, g in enumerate(names)}

    def matrix(part):
        x = np.zeros((len(part), len(names)))
        for r, (ws, _, _) in enumerate(part):
            for g in grams(ws):
                if g in at:
                    x[r, at[g]] = 1.0
        return x, np.array([k for _, k, _ in part])

    def probs(x):
        z = x @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    fit, back = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    x, y = matrix(fit)
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    hot = np.eye(len(classes))[y]
    for _ in range(rounds):
        g = (probs(x) - hot) / len(y)
        w -= rate * (x.T @ g + 1e-4 * w)
        b -= rate * g.sum(axis=0)
    x, y = matrix(back)
    p = probs(x)
    known = y < len(classes) - 1
    sure = np.where(known, p[np.arange(len(y)), y], 0.0), p[:, :-1].max(axis=1)
    # cuts lie midway between the scores of kept-back lines; the best has most lines on their side, the highest of equals
    at = np.unique(np.r_[0.0, sure[0][known], sure[1][~known], 1.0])
    cuts = (at[1:] + at[:-1]) / 2
    right = [(sure[0][known] >= c).mean() + (sure[1][~known] < c).mean() for c in cuts]
    cut = float(cuts[len(cuts) - 1 - int(np.argmax(right[::-1]))])
    keep = np.abs(w).max(axis=1) > 0.02
    return classes, {n: [round(float(v), 6) for v in w[i]] for i, n in enumerate(names) if keep[i]}, [round(float(v), 6) for v in b], cut


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0))


def _grams(ws: Column, n: int) -> Column:
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
    # entries are read one by one: a slice would copy the array for every gram
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(ws, i + k) for k in range(n)]))


def templates() -> list[tuple[str, int, str, int]]:
    """family, notice, word 3-gram, number of the notice's distinct ones."""
    every = [(c, t) for c in NOTICES for t in NOTICES[c] + FULL.get(c, [])]
    sets = [{" ".join(tokens(t)[k : k + 3]) for k in range(max(1, len(tokens(t)) - 2))} for _, t in every]
    return [(c, i, g, len(s)) for i, ((c, _), s) in enumerate(zip(every, sets)) for g in sorted(s)]


def _probable(d: DataFrame, keys: list[str]) -> DataFrame:
    """keys, family, probability of word arrays `ws` whose family passes the cut."""
    classes, weights, bias, least = train()
    # bounded by the notices above, whatever the input
    model = d.sparkSession.createDataFrame([(g, v) for g, v in weights.items()], "gram string, w array<double>")
    g = d.select(*keys, F.explode(F.array_distinct(F.concat(*[_grams(F.col("ws"), n) for n in range(1, ORDER + 1)]))).alias("gram")).join(F.broadcast(model), "gram")
    z = g.groupBy(*keys).agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(classes))])
    logits = F.array(*[F.struct((F.col(f"z{i}") + bias[i]).alias("z"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    z = z.withColumn("zs", logits).withColumn("top", F.array_max("zs"))
    total = F.aggregate("zs", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - F.col("top")["z"]))
    return z.select(*keys, F.col("top")["c"].alias("family"), F.round(1 / total, 6).alias("probability")).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= least))


def _stretches(d: DataFrame, notices: DataFrame) -> DataFrame:
    """h1, h2, ws, family, similarity: the stretches of lines that hold enough of a notice, with ORDER words around.

    Matches are counted in blocks of twice the notice's length, one beginning
    at each multiple of it: every window of notice length lies in a block.
    """
    at = d.select("h1", "h2", F.posexplode(_grams(F.col("ws"), 3)).alias("pos", "gram")).join(F.broadcast(notices), "gram")
    at = at.withColumn("block", F.explode(F.array(F.expr("pos div n"), F.expr("pos div n") - 1)))
    s = at.groupBy("h1", "h2", "notice", "block").agg(F.first("family").alias("family"), (F.count_distinct("gram") / F.first("n")).alias("similarity"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    s = s.filter(F.col("similarity") >= CONFIRM).groupBy("h1", "h2", "family", "a", "b").agg(F.round(F.max("similarity"), 6).alias("similarity"))
    a = F.greatest(F.col("a") - ORDER, F.lit(0))
    return d.join(s, ["h1", "h2"]).select("h1", "h2", F.slice("ws", a + 1, F.col("b") + 3 + ORDER - a).alias("ws"), "family", "similarity")


def classify_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """line, family, probability, similarity, confirmed for each distinct line and family found in it; unknown ones are left out."""
    notices = lines.sparkSession.createDataFrame(templates(), "family string, notice int, gram string, n int")
    # written, so that words are found once and not again for every gram read from them
    d = cut(lines.select(line).distinct().select(line, F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2"), _tokens(F.col(line)).alias("ws")))
    keys = ["h1", "h2"]
    three = F.when(F.size("ws") >= 3, F.array_distinct(_grams(F.col("ws"), 3))).otherwise(F.array(F.array_join("ws", " ")))
    z = d.join(_probable(d, keys), keys).withColumn("grams", three)
    hit = z.select(*keys, "family", F.explode("grams").alias("gram")).join(F.broadcast(notices), ["family", "gram"]).groupBy(*keys, "notice").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("n"))
    whole = cut(z.select(*keys, "family", "probability", F.size("grams").alias("size")).join(hit, keys, "left").select(*keys, "family", "probability", F.round(F.coalesce("n", F.lit(0)) / F.col("size"), 6).alias("similarity")))
    # a stretch tells of what its whole line has not confirmed; equal ones are classified once
    s = cut(_stretches(d, notices).join(whole.filter(F.col("similarity") >= CONFIRM), [*keys, "family"], "left_anti"))
    part = s.join(_probable(s.select("ws").distinct(), ["ws"]), ["ws", "family"]).groupBy(*keys, "family").agg(F.max(F.struct("probability", "similarity")).alias("best"))
    part = part.select(*keys, "family", "best.probability", "best.similarity")
    found = whole.join(part, [*keys, "family"], "left_anti").unionByName(part)
    return d.select(line, *keys).join(found, keys).select(line, "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"))


def candidates(text: Column) -> Column:
    """The paragraphs of a text that share a word 3-gram with a notice.

    Three words in a row of the notices' vocabulary come first: few paragraphs
    of other prose have them, so few 3-grams are built.
    """
    known = sorted({g for _, _, g, _ in templates()})
    vocabulary = sorted({w for g in known for w in g.split(" ")})
    paragraphs = F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n")

    def meets(x: Column) -> Column:
        # words outside the vocabulary are blanked, and what is left is split at them
        held = F.transform(_tokens(x), lambda w: F.when(w.isin(vocabulary), w).otherwise(""))
        return F.exists(F.split(F.array_join(held, " "), " {2,}"), lambda r: F.exists(_grams(F.split(F.trim(r), " "), 3), lambda g: g.isin(known)))

    return F.filter(paragraphs, meets)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, family (null: none), probability, similarity, n_paragraphs (candidates), n_confirmed, families."""
    cue = candidates(df[text])
    hash_ = lambda i: F.xxhash64(F.lit(i), df[key], df[text])
    d = df.select(df[key].alias("_key"), hash_(1).alias("k1"), hash_(2).alias("k2"), F.transform(cue, lambda x: F.trim(x)).alias("lines"))
    d = cut(d)
    at = d.select("k1", "k2", F.posexplode("lines").alias("pos", "line"))
    seen = cut(classify_lines(at))
    per = at.join(seen, "line").groupBy("k1", "k2").agg(
        F.max(F.when(F.col("confirmed"), F.struct("probability", "similarity", F.lit("").alias("x")))).alias("best"),
        F.collect_set(F.when(F.col("confirmed"), F.struct(F.col("family").alias("family"), F.col("probability").alias("probability"), F.col("similarity").alias("similarity")))).alias("all"),
        F.countDistinct(F.when(F.col("confirmed"), F.col("pos"))).alias("n_confirmed"),
    )
    best = F.filter("all", lambda x: (x["probability"] == F.col("best.probability")) & (x["similarity"] == F.col("best.similarity")))
    per = per.select("k1", "k2", F.array_min(F.transform(best, lambda x: x["family"])).alias("family"), F.col("best.probability").alias("probability"), F.col("best.similarity").alias("similarity"), "n_confirmed", F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["family"]))), ",").alias("families"))
    out = d.join(per, ["k1", "k2"], "left")
    return out.select(F.col("_key").alias(key), "family", "probability", "similarity", F.size("lines").cast("long").alias("n_paragraphs"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"))
