"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences: at ``.``, ``!``, ``?``, ``:`` or ``;`` before white space or the end, and at lines that
hold no ASCII letter or digit (blank ones, or comment marks alone). Other line ends stay inside a sentence, so a notice
is read alike whether it is wrapped, behind comment marks or on one line. A sentence's normal form is its ASCII letters
and digits in lower case, run together. A sentence that is known maps to its identifier; of one that is not, so do its
lines that are known (titles and notices without a full stop). SPDX tags come before all sentences. What remains of a
text is its sequence of identifiers, which ordered rules read: a rule holds where its identifiers appear in its order,
others may stand between, unless they go on to a longer rule's of another licence. Everything stays in the row: no
exchange.

Defined cases: a null or empty text has no sentence and no licence; a text of any length is read whole, in time in
proportion to its length; repeated sentences repeat in the sequence and count once as a licence; a repeated row gets the
same answer; an empty table gives no rows; columns other than the named ones are ignored, whatever their names. Comment
marks that are words (``rem``, ``dnl``) are read as words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence sentences and clauses, written as they stand in notices, by identifier.
SENTENCES = {
    1: ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License", "The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT"],
    2: ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    3: ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    4: ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    5: ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    6: ["you may not use this file except in compliance with the License"],
    7: ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    8: ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    9: ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    10: ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    11: ["either version 2 of the License, or (at your option) any later version"],
    12: ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    13: ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    14: ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    15: ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "SPDX-License-Identifier: CC0-1.0"],
    16: ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    17: ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    18: ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    19: ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    20: ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "SPDX-License-Identifier: MPL-2.0"],
    21: ["All rights reserved"],
    22: ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "ISC License", "SPDX-License-Identifier: ISC"],
    23: ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    24: ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    25: ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    26: ["either version 2.1 of the License, or (at your option) any later version"],
    27: ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    28: ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    29: ["SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    30: ["SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    31: ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "SPDX-License-Identifier: EPL-2.0"],
    32: ["This software is provided 'as-is', without any express or implied warranty"],
    33: ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "SPDX-License-Identifier: Zlib"],
    34: ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"],
    35: ["Licensed under the Artistic License 2.0", "The Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0"],
    36: ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    37: ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    38: ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    39: ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: 0BSD"],
    40: ["SPDX-License-Identifier: BSD-3-Clause"],
    41: ["SPDX-License-Identifier: BSD-2-Clause"],
}
#: Rules in their order: the first that holds for a licence names how it was recognised.
RULES = [
    ("MIT", [2, 3, 4]),
    ("MIT", [2, 3]),
    ("MIT", [1]),
    ("Apache-2.0", [5, 6, 7]),
    ("Apache-2.0", [5]),
    ("GPL-3.0", [9, 10]),
    ("GPL-3.0", [9]),
    ("GPL-3.0", [8]),
    ("GPL-2.0-or-later", [24, 11, 10]),
    ("GPL-2.0-or-later", [24, 11]),
    ("GPL-2.0", [30]),
    ("LGPL-2.1", [25, 26]),
    ("LGPL-2.1", [29]),
    ("LGPL-3.0", [27]),
    ("AGPL-3.0", [28]),
    ("BSD-3-Clause", [16, 17, 18, 19]),
    ("BSD-3-Clause", [40]),
    ("BSD-2-Clause", [16, 17, 18]),
    ("BSD-2-Clause", [41]),
    ("MPL-2.0", [20]),
    ("EPL-2.0", [31]),
    ("Zlib", [32, 33]),
    ("Zlib", [33]),
    ("BSL-1.0", [34]),
    ("Artistic-2.0", [35]),
    ("ISC", [22]),
    ("0BSD", [39]),
    ("Unlicense", [23]),
    ("CC-BY-NC-SA-4.0", [37]),
    ("CC-BY-NC-ND-4.0", [38]),
    ("CC-BY-NC-4.0", [12]),
    ("CC-BY-SA-4.0", [14]),
    ("CC-BY-ND-4.0", [36]),
    ("CC-BY-4.0", [13]),
    ("CC0-1.0", [15]),
    ("proprietary", [21]),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences; what stands between them, but for letters, digits and line ends, goes.
BREAK = r"""[.!?:;]+["')\]]*([ \t\n\r\f]|\z)|\n[^A-Za-z0-9]*\n"""
STRIP = r"[^A-Za-z0-9\n\x01]+"
SPDX = "SPDX-License-Identifier:"
SPDX_TAG = SPDX + r"[ \t]*([A-Za-z0-9.+-]*[A-Za-z0-9+])"
SPDX_KEY = "spdxlicenseidentifier"


def cut(text: Column) -> Column:
    """The sentences of a text, in order, as lower-case letters and digits with their line ends."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), BREAK, "\x01")
    return F.filter(F.split(F.lower(F.regexp_replace(marked, STRIP, "")), "\x01", -1), lambda s: s.rlike("[a-z0-9]"))


def _normal(sentence: str) -> str:
    """The normal form of a fixed sentence, which is no longer than the cutter leaves it."""
    if sentence.startswith(SPDX):
        return re.sub("[^a-z0-9]", "", sentence.lower())
    pieces = [re.sub("[^a-z0-9]", "", p.lower()) for p in re.sub(BREAK.replace(r"\z", r"\Z"), "\x01", sentence).split("\x01")]
    (whole,) = filter(None, pieces)
    return whole


def sentence_ids() -> dict[str, int]:
    return {_normal(s): k for k, group in SENTENCES.items() for s in group}


def wider(name: str, ids: list[int]) -> list[list[int]]:
    """Sentences of other licences' rules that begin with all of a rule's: where those hold, the shorter notice is part of theirs."""
    return [more for other, more in RULES if other != name and len(more) > len(ids) and more[: len(ids)] == ids]


def _holds(ids: list[int]) -> Column:
    return F.col("sequence").like(_pattern(ids))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _pattern(ids: list[int]) -> str:
    return "%" + "%".join(f"<{k}>" for k in ids) + "%"


def scan_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``n_sentences``, ``sentence_ids`` (its sequence), ``licenses`` (by rule order), ``n_licenses``."""
    known = sentence_ids()
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    content = F.coalesce(F.col(text), F.lit(""))
    tags = F.when(F.contains(content, F.lit(SPDX)), F.transform(F.regexp_extract_all(content, F.lit(SPDX_TAG), F.lit(1)), lambda t: F.concat(F.lit(SPDX_KEY), F.lower(F.regexp_replace(t, "[^A-Za-z0-9]+", "")))))
    split = documents.select(F.col(doc_id).alias(doc_id), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), cut(F.col(text)).alias("sentences"))

    def units(s: Column) -> Column:
        """The sentence as one if it is known, else its lines, else nothing."""
        whole = F.replace(s, F.lit("\n"), F.lit(""))
        lines = F.filter(F.split(s, "\n", -1), lambda line: line.isin(*known))
        return F.when(whole.isin(*known), F.array(whole)).when(F.contains(s, F.lit("\n")), lines).otherwise(F.array().cast("array<string>"))

    hits = F.concat(F.filter("tags", lambda t: t.isin(*known)), F.flatten(F.transform("sentences", units)))
    marked = split.select(doc_id, F.size("sentences").cast("long").alias("n_sentences"), F.transform(hits, lambda s: lookup[s]).alias("ids"))
    sequence = F.array_join(F.transform("ids", lambda k: F.concat(F.lit("<"), k.cast("string"), F.lit(">"))), "")
    marked = marked.withColumn("sequence", sequence)
    held = F.array_distinct(
        F.filter(
            F.array(*[F.when(_holds(ids) & ~_any([_holds(more) for more in wider(name, ids)]), F.lit(name)) for name, ids in RULES]),
            lambda x: x.isNotNull(),
        )
    )
    return marked.select(
        doc_id,
        "n_sentences",
        F.array_join(F.transform("ids", lambda k: k.cast("string")), ",").alias("sentence_ids"),
        F.array_join(held, ",").alias("licenses"),
        F.size(held).cast("long").alias("n_licenses"),
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_sql() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    known = sentence_ids()
    keys, values = ", ".join(_quoted(k) for k in known), ", ".join(str(v) for v in known.values())
    rules = ", ".join(
        "CASE WHEN " + " AND NOT ".join("sequence LIKE " + _quoted(_pattern(x)) for x in [ids, *wider(name, ids)]) + f" THEN {_quoted(name)} END"
        for name, ids in RULES
    )
    order = "[" + ", ".join(_quoted(x) for x in dict.fromkeys(name for name, _ in RULES)) + "]"
    member = lambda s: f"list_contains([{keys}], {s})"
    pattern = BREAK.replace("'", "''")
    flat = rf"lower(regexp_replace(regexp_replace(coalesce(text, ''), '{pattern}', chr(1), 'g'), '{STRIP}', '', 'g'))"
    return rf"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split({flat}, chr(1)), lambda s: regexp_matches(s, '[a-z0-9]')) AS sentences,
         list_transform(regexp_extract_all(coalesce(text, ''), '{SPDX_TAG}', 1), lambda t: '{SPDX_KEY}' || lower(regexp_replace(t, '[^A-Za-z0-9]+', '', 'g'))) AS tags FROM documents
), hit AS (
  SELECT doc_id, len(sentences) AS n_sentences, list_concat(list_filter(tags, lambda t: {member("t")}), flatten(list_transform(sentences, lambda s:
         CASE WHEN {member("replace(s, chr(10), '')")} THEN [replace(s, chr(10), '')]
              WHEN contains(s, chr(10)) THEN list_filter(string_split(s, chr(10)), lambda l: {member("l")}) ELSE [] END))) AS hits FROM cut
), marked AS (
  SELECT doc_id, n_sentences, list_transform(hits, lambda s: map([{keys}], [{values}])[s]) AS ids FROM hit
), sequenced AS (
  SELECT doc_id, n_sentences, ids, coalesce(array_to_string(list_transform(ids, lambda k: '<' || k || '>'), ''), '') AS sequence FROM marked
), ruled AS (
  SELECT *, list_filter([{rules}], lambda x: x IS NOT NULL) AS names FROM sequenced
), held AS (
  SELECT *, list_filter({order}, lambda x: list_contains(names, x)) AS licenses FROM ruled
)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, coalesce(array_to_string(list_transform(ids, lambda k: CAST(k AS VARCHAR)), ','), '') AS sentence_ids,
       coalesce(array_to_string(licenses, ','), '') AS licenses, CAST(len(licenses) AS BIGINT) AS n_licenses
FROM held"""
