"""Licence scans by sentence rules (DataFrame functions only).

A text is cut into sentences, each normalised (lower case, runs of anything but letters and digits
as one space) and looked up among known licence sentences; the identifiers found, in order and with
their sentence positions, are matched against ordered rules. A rule holds where its identifiers
follow one another among the recognised sentences, with at most `gap` unknown sentences between two
of them. The same is done line by line, for notices that stand on a line of their own next to text
without punctuation; the licences of both readings are joined.

Everything happens inside the row: no shuffle, no join. NULL and empty texts have no licence; each
input row gives one row, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import let

# known licence sentences as they appear in the licences' own texts and customary notices
SENTENCES = {
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "mit-line-3": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                 "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
                  "the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
                    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-line-2": "Released under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                    "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-line-2": "Licensed under the GNU General Public License, version 3.",
    "gpl2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                  "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                  "Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-later-a": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                    "Free Software Foundation;",
    "gpl2-later-b": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                        "the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                   "products derived from this software without specific prior written permission.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mpl-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-line-a": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
}
PARTS = {"mpl-line-b": "2.0."}  # what the cutter leaves of a known sentence, without a word of ANCHOR: only as a rule's later part
RULES = (
    ("Apache-2.0", ("apache-line",)), ("Apache-2.0", ("apache-line-2",)), ("Apache-2.0", ("apache-header", "apache-comply")),
    ("Apache-2.0", ("apache-obtain", "apache-basis")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("CC-BY-4.0", ("cc-by-line",)), ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)), ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)), ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("GPL-2.0", ("gpl2-line",)), ("GPL-2.0-or-later", ("gpl2-later-a", "gpl2-later-b", "gpl-hope")),
    ("GPL-3.0", ("gpl3-line",)), ("GPL-3.0", ("gpl3-line-2",)), ("GPL-3.0-or-later", ("gpl3-later", "gpl-hope")),
    ("MIT", ("mit-line",)), ("MIT", ("mit-line-2",)), ("MIT", ("mit-line-3",)), ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MPL-2.0", ("mpl-line",)), ("MPL-2.0", ("mpl-line-a", "mpl-line-b")),
)
GAP = 3
ANCHOR = r"(?i)licen[cs]e|redistribut|permission|warrant|copyright"  # every known sentence holds one of them
CUT = "\u0001"
SENTENCE_END = r"([.!?;:])\s+|\n\s*\n"


def normal(sentence: str) -> str:
    """What normalised() makes of an ASCII sentence."""
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


# a sentence that the cutter itself would cut is known by its parts only where those are listed
KNOWN = {normal(s): k for k, s in {**SENTENCES, **PARTS}.items()}


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def recognised(text: Column) -> Column:
    """array<struct<pos, id>> of the known sentences, in order."""
    table = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    parts = F.transform(F.split(F.regexp_replace(text, SENTENCE_END, f"$1{CUT}"), f"[{CUT}]"), normalised)
    numbered = let(parts, lambda p: F.transform(p, lambda s, i: F.struct(i.alias("pos"), s.alias("s"))))
    hits = F.filter(numbered, lambda x: x["s"].isin(*KNOWN))
    return F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), F.element_at(table, x["s"]).alias("id")))


def _holds(seq: Column, rule: tuple[str, ...], gap: int) -> Column:
    def at(j: Column) -> Column:
        ok = F.get(seq, j)["id"] == rule[0]
        for t in range(1, len(rule)):
            here, before = F.get(seq, j + t), F.get(seq, j + (t - 1))
            ok = ok & (here["id"] == rule[t]) & (here["pos"] - before["pos"] <= gap + 1)
        return F.coalesce(ok, F.lit(False))

    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(seq) - 1, F.lit(0))), at)


def _licences(seq: Column, gap: int) -> Column:
    return F.array_compact(F.array(*[F.when(_holds(seq, rule, gap), F.lit(name)) for name, rule in RULES]))


def scan(docs: DataFrame, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences (sorted, comma-joined), sentences (identifiers in order, comma-joined), n_sentences."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(text.rlike(ANCHOR), F.translate(text, CUT, " ")).otherwise(F.lit(""))  # most texts stop here
    seqs = docs.select(F.col(id_col).alias("doc_id"), let(text, lambda t: F.when(t == "", F.array(F.lit(None), F.lit(None))).otherwise(
        F.array(recognised(t), recognised(F.regexp_replace(t, r"\n", "\n\n"))))).alias("seqs"))
    none = F.array().cast("array<struct<pos:int,id:string>>")
    rows = seqs.select("doc_id", F.coalesce(F.get("seqs", F.lit(0)), none).alias("a"), F.coalesce(F.get("seqs", F.lit(1)), none).alias("b"))
    both = F.sort_array(F.array_union(_licences(F.col("a"), gap), _licences(F.col("b"), gap)))
    return rows.select("doc_id", F.array_join(both, ",").alias("licences"),
                       F.array_join(F.transform("a", lambda x: x["id"]), ",").alias("sentences"),
                       F.size("a").cast("long").alias("n_sentences"))


def scan_sql(gap: int = GAP) -> str:
    """The same in DuckDB SQL over the table documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in KNOWN.items()) + "}"

    def holds(col: str, rule: tuple[str, ...]) -> str:
        ok = [f"{col}[j].id = {q(rule[0])}"] + [
            f"{col}[j + {t}].id = {q(rule[t])} AND {col}[j + {t}].pos - {col}[j + {t - 1}].pos <= {gap + 1}" for t in range(1, len(rule))]
        return f"len(list_filter(range(1, len({col}) + 1), lambda j: coalesce({' AND '.join(ok)}, false))) > 0"

    names = " ".join(f"CASE WHEN {holds('a', r)} OR {holds('b', r)} THEN {q(n)} END,"
                     for n, r in RULES)[:-1]
    parts = lambda text: f"""list_transform(string_split(regexp_replace({text}, '([.!?;:])\\s+|\\n\\s*\\n', '\\1' || chr(1), 'g'), chr(1)),
        lambda s: known.m[trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))])"""  # noqa: E731
    numbered = lambda c: f"""list_filter(list_transform({c}, lambda x, i: {{'pos': i, 'id': x}}), lambda y: y.id IS NOT NULL)"""
    return f"""
WITH known AS (SELECT {known} AS m),
d AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), {q(ANCHOR)}) THEN replace(text, chr(1), ' ') ELSE '' END AS t
      FROM documents),
s AS (SELECT doc_id, {parts('t')} AS pa, {parts("replace(t, chr(10), chr(10) || chr(10))")} AS pb FROM d, known),
r AS (SELECT doc_id, {numbered('pa')} AS a, {numbered('pb')} AS b FROM s)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licences,
       array_to_string(list_transform(a, lambda x: x.id), ',') AS sentences, CAST(len(a) AS BIGINT) AS n_sentences
FROM r"""
