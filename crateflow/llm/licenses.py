"""License notices in documents: MinHash bands over overlapping windows, then exact shingle containment. Native only.

Shingles have five words; a template of fewer words is one shingle of its own. A template of T shingles belongs to the class X, the least power of two not under T. Windows of the class
take X + X/4 - 1 shingles in steps of X/4, so some window holds any X shingles in a row. A window that holds 0.8 of a
template has a Jaccard similarity with it of 0.3 at least, and meets it in one of 32 one-row bands with a probability
of 1 - 0.7**32 = 0.99999 at least; what meets is then compared shingle by shingle.

Templates that hold 0.8 of each other (versions of a notice) are one family; a document gets those of a family that it
holds best.

Only windows with a cue word are hashed. That loses nothing: over a fifth of each template's shingles hold a cue word
(checked when a table of templates is made), so a window without one holds less than 0.8 of every template.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateflow.llm.common import col

SHINGLE, BANDS, LEAST = 5, 32, 0.8
# Notices as their publishers word them, and words that they can't do without.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-style-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-style-line": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-3.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-work-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-short-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-short-line": "Licensed under CC BY-SA 4.0.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX-LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1",
    "SPDX-AGPL-3.0": "SPDX-License-Identifier: AGPL-3.0",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "SPDX-ISC": "SPDX-License-Identifier: ISC",
    "SPDX-CC0-1.0": "SPDX-License-Identifier: CC0-1.0",
    "All-rights-reserved": "All rights reserved",
}
CUES = ("license", "licensed", "licence", "licenced", "software", "copyright", "permission", "redistribution", "redistributions", "redistribute", "conditions", "reserved", "spdx", "eclipse", "mozilla", "mpl", "unencumbered", "domain")


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _class(t: int) -> tuple[int, int, int]:
    """(X, shingles of a window, step) for a template of t shingles."""
    x = 1
    while x < t:
        x *= 2
    step = max(1, x // 4)
    return x, x + step - 1, step


def template_rows(templates: dict[str, str] = TEMPLATES, cues: tuple[str, ...] = CUES) -> list[dict]:
    """Each template's shingles, class, window and family; raises where a template has no word or its cues are too few."""
    out = []
    for name, text in sorted(templates.items()):
        w = words_of(text)
        width = min(SHINGLE, len(w))
        shingles = sorted({" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}) if w else []
        if not shingles:
            raise ValueError(f"{name}: no words")
        if sum(any(c in s.split() for c in cues) for s in shingles) <= (1 - LEAST) * len(shingles):
            raise ValueError(f"{name}: a text may hold {LEAST} of it without any cue word")
        _, window, step = _class(len(shingles))
        out.append({"license_id": name, "shingles": shingles, "width": width, "window": window, "step": step, "family": name})
    for row in out:  # named by the first of its members
        for other in out:
            common = len(set(row["shingles"]) & set(other["shingles"]))
            if common >= LEAST * max(len(row["shingles"]), len(other["shingles"])):
                old, new = max(row["family"], other["family"]), min(row["family"], other["family"])
                for x in out:
                    x["family"] = new if x["family"] == old else x["family"]
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _keys(hashes: str) -> str:
    """SQL: the bands of the MinHash of an array of shingle hashes, each band with its number in it."""
    return f"transform(sequence(1, {BANDS}), b -> xxhash64(b, array_min(transform({hashes}, h -> xxhash64(h, b)))))"


def _once(df: DataFrame, **columns: str) -> DataFrame:
    """Columns evaluated once a row: the optimizer does not copy them into the expressions that use them."""
    fields = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return df.select("*", F.expr(f"inline(array(struct({fields})))"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, cues: tuple[str, ...] = CUES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, containment (the best of its windows) and first_word (of the first window with the best).

    One row for each document and template with a window that holds 0.8 or more of the template's shingles; of a
    family of templates, those with the document's best containment. Words are runs of letters and digits, lower-cased.
    Null, empty and clean texts give no rows; rows that share a doc_id (null counts as one) give one row together; other
    columns are not read.
    """
    spark = docs.sparkSession
    table = template_rows(templates, cues)
    widths = sorted({r["width"] for r in table})
    bank = spark.createDataFrame([(r["license_id"], r["family"], r["shingles"], r["width"], widths.index(r["width"]) + 1, r["window"], r["step"]) for r in table], "license_id string, family string, shingles array<string>, width int, nth int, window int, step int")
    bank = bank.select("*", F.expr("transform(shingles, s -> xxhash64(s))").alias("hashes")).select("license_id", "family", "shingles", "width", "nth", "window", "step", F.expr(_keys("hashes")).alias("keys"))
    classes = bank.groupBy("width", "nth", "window", "step").agg(F.collect_list(F.struct("license_id", "family", "shingles", "keys")).alias("templates"))

    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), F.lower(col(docs, text_col)).alias("t"))
    stems = sorted({c[:6] for c in cues})
    hint = None
    for s in stems:
        hint = F.contains("t", F.lit(s)) if hint is None else hint | F.contains("t", F.lit(s))
    rows = _once(rows.where(hint), w="filter(split(t, '[^\\\\p{L}\\\\p{N}]+'), x -> x <> '')").where(f"size(w) >= {widths[0]}").drop("t")
    marked = "array_contains(array(" + ", ".join(map(_quoted, cues)) + "), x)"
    rows = _once(rows, cue=f"filter(transform(w, (x, i) -> if({marked}, i, -1)), p -> p >= 0)").where("size(cue) > 0")
    hashed = ", ".join(f"if(size(w) < {k}, array(), transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(array_join(slice(w, i, {k}), ' '))))" for k in widths)
    rows = _once(rows, each=f"array({hashed})")
    # the templates' classes: a handful of rows, as many as the template table has lengths
    rows = _once(rows.crossJoin(F.broadcast(classes)), h="element_at(each, nth)").drop("each")
    first = "cast(ceil(greatest(p - window - width + 2, 0) / step) * step AS int)"
    last = "cast(floor(least(p, size(h) - 1) / step) * step AS int)"
    rows = _once(rows, at=f"array_distinct(flatten(transform(cue, p -> if({first} <= {last}, sequence({first}, {last}, step), array()))))")
    met = f"transform(at, s -> struct(s AS s, {_keys('slice(h, s + 1, window)')} AS k))"
    rows = _once(rows, met=met)
    pairs = "flatten(transform(met, m -> transform(filter(templates, t -> arrays_overlap(t.keys, m.k)), t -> struct(m.s AS s, t.license_id AS license_id, t.family AS family, t.shingles AS shingles))))"
    rows = _once(rows, pair=pairs).where("size(pair) > 0")
    own = f"transform(sequence(p.s + 1, least(p.s + window, size(h))), i -> array_join(slice(w, i, width), ' '))"
    held = f"transform(pair, p -> struct(p.license_id AS license_id, p.family AS family, p.s AS s, size(array_intersect(p.shingles, {own})) / size(p.shingles) AS c))"
    found = rows.select("doc_id", F.expr(f"inline(filter({held}, x -> x.c >= {LEAST}))"))
    best = found.groupBy("doc_id", "family", "license_id").agg(F.max(F.struct(F.col("c"), (-F.col("s")).alias("m"))).alias("b"))
    best = best.withColumn("top", F.max("b.c").over(Window.partitionBy("doc_id", "family"))).where("b.c = top")
    return best.select("doc_id", "license_id", F.col("b.c").alias("containment"), (-F.col("b.m")).cast("long").alias("first_word"))
