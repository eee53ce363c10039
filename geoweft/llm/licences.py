"""Licence scans by sentence rules.

A text is normalised and its breaks are marked: ends of sentences, lines and paragraphs.  Known licence
sentences between two breaks become their identifiers, however their own lines are wrapped and their
clauses are set off, but not across blank lines; the sequence of identifiers is matched against ordered rules, the most specific first,
and what a rule has matched is used up and leaves a bar that no later rule matches across.  Per-row
DataFrame functions only: no shuffle, no join.

Edge cases: null and empty texts have no sentence and no licence; very long texts are scanned whole; of two
known sentences at one place the longer counts, of rules the earlier; repeated rows are scanned each; an
empty table gives an empty result; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import narrow

# Known licence sentences, normalised (lower case, words of a-z and 0-9, one blank).
SENTENCES: dict[int, str] = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "released under the mit license",
    6: "licensed under the mit license",
    7: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    8: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    9: "the software is provided as is without warranty of any kind express or implied",
    10: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    11: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    12: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    13: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    14: "licensed under the bsd 3 clause license",
    15: "licensed under the bsd 2 clause license",
    16: "this work is licensed under the gnu general public license version 3",
    17: "this work is licensed under the gnu general public license version 2",
    18: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    19: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    20: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    21: "licensed under the gnu lesser general public license version 3",
    22: "licensed under cc by nc 4 0",
    23: "licensed under cc by 4 0",
    24: "licensed under cc by sa 4 0",
    25: "licensed under cc by nc sa 4 0",
    26: "licensed under cc by nd 4 0",
    27: "licensed under cc by nc nd 4 0",
    28: "this work is licensed under a creative commons attribution 4 0 international license",
    29: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    30: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    31: "this work is dedicated to the public domain under the cc0 1 0 universal licence",
    32: "released under the mozilla public license version 2 0",
    33: "this source code form is subject to the terms of the mozilla public license v 2 0",
    34: "all rights reserved without permission of the copyright holder",
    35: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    36: "this is free and unencumbered software released into the public domain without a licence fee",
    37: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    38: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    39: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    40: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    41: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    42: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    43: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    44: "distributed under the boost software license version 1 0",
    45: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    46: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    47: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    48: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    49: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    50: "licensed under the gnu affero general public license version 3",
    51: "licensed under the bsd 4 clause license",
    52: "released under the isc license",
    53: "licensed under the eclipse public license version 2 0",
}

# Other forms of known sentences, as in the full texts; a * is a name of up to twelve words.
FORMS: list[tuple[int, str]] = [
    (7, SENTENCES[7] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    (9, SENTENCES[9] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (13, "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (35, SENTENCES[35].replace("and or", "and")),
    (36, "this is free and unencumbered software released into the public domain"),
]

# Ordered rules, a licence identifier and the sentence identifiers in order.
RULES: list[tuple[str, list[int]]] = [
    ("MIT", [7, 8, 9]),
    ("BSD-4-Clause", [10, 11, 12, 48, 13]),
    ("BSD-3-Clause", [10, 11, 12, 13]),
    ("BSD-2-Clause", [10, 11, 12]),
    ("GPL-3.0-or-later", [18, 20]),
    ("GPL-2.0-or-later", [19, 20]),
    ("AGPL-3.0-or-later", [38, 20]),
    ("LGPL-2.1-or-later", [39, 41]),
    ("LGPL-3.0-or-later", [40, 41]),
    ("GPL-2.0-only", [42, 20]),
    ("Apache-2.0", [1, 3, 4]),
    ("Apache-2.0", [2, 3, 4]),
    ("GPL-3.0-or-later", [18]),
    ("GPL-2.0-or-later", [19]),
    ("MIT", [7]),
    ("Apache-2.0", [1]),
    ("Apache-2.0", [2]),
    ("MIT", [5]),
    ("MIT", [6]),
    ("BSD-3-Clause", [14]),
    ("BSD-2-Clause", [15]),
    ("GPL-3.0-only", [16]),
    ("GPL-2.0-only", [17]),
    ("LGPL-3.0-only", [21]),
    ("CC-BY-NC-4.0", [22]),
    ("CC-BY-4.0", [23]),
    ("CC-BY-SA-4.0", [24]),
    ("CC-BY-NC-SA-4.0", [25]),
    ("CC-BY-ND-4.0", [26]),
    ("CC-BY-NC-ND-4.0", [27]),
    ("CC-BY-4.0", [28]),
    ("CC-BY-SA-4.0", [29]),
    ("CC-BY-NC-4.0", [30]),
    ("CC0-1.0", [31]),
    ("MPL-2.0", [32]),
    ("MPL-2.0", [33]),
    ("LicenseRef-proprietary", [34]),
    ("ISC", [35]),
    ("Unlicense", [36]),
    ("0BSD", [37]),
    ("AGPL-3.0-or-later", [38]),
    ("LGPL-2.1-or-later", [39]),
    ("LGPL-3.0-or-later", [40]),
    ("GPL-2.0-only", [42]),
    ("BSL-1.0", [43]),
    ("BSL-1.0", [44]),
    ("Zlib", [45]),
    ("WTFPL", [46]),
    ("EPL-2.0", [47]),
    ("MIT-0", [49]),
    ("AGPL-3.0-only", [50]),
    ("BSD-4-Clause", [51]),
    ("ISC", [52]),
    ("EPL-2.0", [53]),
]

#: Every known sentence holds one of these, so texts without any need no cutting.
ANCHORS = ("licen", "copyright", "permi", "warrant", "unencumbered", "advertising")

_END = "[.;:!?]+([ \\t\\r\\n]|$)"


#: Capitals do not occur in lower case, so they mark ends of sentences and of paragraphs.
_GAP, _EDGE = "[ \\nS]+", "[^\\nSP]"


def marked(text: Column) -> Column:
    """Words of a text with one blank between, and its breaks: S ends a sentence, \\n a line, P a paragraph."""
    cut = F.regexp_replace(F.lower(text), _END, "S$1")
    words = F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9\\nS]+", " "), " ?([\\nS]) ?", "$1")
    return F.trim(F.regexp_replace(words, "\\n(?: ?\\n)+ ?", "P"))


def _pattern(sentence: str) -> str:
    return _GAP.join(sentence.split(" ")).replace("*", f"[a-z0-9]+(?:{_GAP}[a-z0-9]+){{0,11}}?")


def identifiers(text: Column, known: dict[int, str] = SENTENCES, forms: list[tuple[int, str]] = FORMS) -> Column:
    """Identifiers of the known sentences, each as ``<id>``, in order; of two at one place the longer counts."""
    every = sorted([*known.items(), *forms], key=lambda x: -len(x[1]))
    table = F.create_map(*(F.lit(x) for k, v in every if "*" not in v for x in (v, f"<{k}>")))
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<!{_EDGE})(?:{'|'.join(_pattern(v) for _, v in every)})(?!{_EDGE})"), F.lit(0))

    def named(sentence: Column) -> Column:
        plain = F.regexp_replace(sentence, _GAP, " ")
        by_name = [(k, v.split("*")) for k, v in every if "*" in v]
        return F.coalesce(F.element_at(table, plain), *(F.when(F.startswith(plain, F.lit(a)) & F.endswith(plain, F.lit(b)), F.lit(f"<{k}>")) for k, (a, b) in by_name))

    return F.when(F.lower(text).rlike("|".join(ANCHORS)), F.array_join(F.transform(found, named), "")).otherwise(F.lit(""))


def match(sequence: Column, rules: list[tuple[str, list[int]]] = RULES) -> Column:
    """Licences of a sequence of identifiers: each rule in turn takes its matches out of the sequence."""
    table = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in rules))
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        return F.struct(
            F.replace(state["rest"], rule["ids"], F.lit("|")).alias("rest"),
            F.when(F.contains(state["rest"], rule["ids"]), F.array_union(state["found"], F.array(rule["licence"]))).otherwise(state["found"]).alias("found"),
        )

    return F.when(sequence == "", F.lit("")).otherwise(F.array_join(F.sort_array(F.aggregate(table, start, step, lambda s: s["found"])), ","))


def scan_licences(docs: DataFrame) -> DataFrame:
    """All documents with ``sentence_ids`` and ``licences`` (sorted, comma-joined; empty if none)."""
    ids = narrow(docs, "doc_id", "text").select("doc_id", F.coalesce(identifiers(F.col("text")), F.lit("")).alias("sentence_ids"))
    return ids.select("doc_id", "sentence_ids", match(F.col("sentence_ids")).alias("licences"))


def oracle(known: dict[int, str] = SENTENCES, forms: list[tuple[int, str]] = FORMS, rules: list[tuple[str, list[int]]] = RULES) -> str:
    """DuckDB SQL for ``scan_licences``.

    Paragraphs are cut into fragments at ends of sentences and lines; runs of fragments are joined and compared
    with the known sentences as a whole, so nothing is searched for inside a text.
    """
    plain = ", ".join(f"({k}, '{v}')" for k, v in [*known.items(), *forms] if "*" not in v)
    named = " ".join(f"WHEN regexp_full_match(s, '{v.replace('*', '[a-z0-9]+( [a-z0-9]+){0,11}')}') THEN {k}" for k, v in forms if "*" in v)
    first = ", ".join(f"'{w}'" for w in sorted({v.split(" ")[0] for v in known.values()}))
    longest = max(len(v) for _, v in [*known.items(), *forms]) + 150
    sql = f"""
      WITH doc AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents),
      clean AS (SELECT r, regexp_replace(regexp_replace(t, '[.;:!?]+([ \\t\\r\\n]|$)', 'S\\1', 'g'), '[^a-z0-9\\nS]+', ' ', 'g') AS t FROM doc WHERE regexp_matches(t, '{"|".join(ANCHORS)}')),
      para AS (SELECT r, generate_subscripts(ps, 1) AS p, unnest(ps) AS t FROM (SELECT r, string_split_regex(t, '\\n( ?\\n)+') AS ps FROM clean)),
      frag AS (SELECT r, p, list_filter(list_transform(string_split_regex(t, '[\\nS]'), lambda x: trim(x)), lambda x: x <> '') AS fs FROM para),
      open AS (SELECT * FROM (SELECT r, p, fs, unnest(range(1, len(fs) + 1)) AS i FROM frag) WHERE split_part(fs[i], ' ', 1) IN ({first})),
      runs AS (SELECT r, p, i, j, array_to_string(fs[i:j], ' ') AS s FROM (SELECT *, unnest(range(i, least(i + 80, len(fs) + 1))) AS j FROM open)),
      sentence(id, s) AS (VALUES {plain}),
      hit AS (SELECT r, p, i, j, coalesce(sentence.id, CASE {named} END) AS id FROM runs LEFT JOIN sentence USING (s) WHERE length(s) <= {longest}),
      longest AS (SELECT r, p, i, max(j) AS j, arg_max(id, j) AS id FROM hit WHERE id IS NOT NULL GROUP BY r, p, i),
      own AS (SELECT * FROM longest a WHERE NOT EXISTS (SELECT 1 FROM longest b WHERE b.r = a.r AND b.p = a.p AND b.i < a.i AND b.j >= a.i)),
      ids AS (SELECT r, string_agg('<' || id || '>', '' ORDER BY p, i) AS ids FROM own GROUP BY r),
      t0 AS (SELECT doc_id, coalesce(ids, '') AS ids, coalesce(ids, '') AS rest, CAST([] AS VARCHAR[]) AS found FROM doc LEFT JOIN ids USING (r))"""
    for i, (name, seq) in enumerate(rules):
        pattern = "".join(f"<{x}>" for x in seq)
        sql += f""",
      t{i + 1} AS (SELECT doc_id, ids, replace(rest, '{pattern}', '|') AS rest,
        CASE WHEN contains(rest, '{pattern}') THEN list_append(found, '{name}') ELSE found END AS found FROM t{i})"""
    return sql + f"""
      SELECT doc_id, ids AS sentence_ids, array_to_string(list_sort(list_distinct(found)), ',') AS licences FROM t{len(rules)}"""
