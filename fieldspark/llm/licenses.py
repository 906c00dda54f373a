"""Licence scan: known sentences become identifiers, ordered rules match the sequence of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: identifier, normalised sentence (words and digits, lower case, single blanks)
SENTENCES = (
    ("mit-name", "released under the mit license"),
    ("mit-name", "licensed under the mit license"),
    ("mit-name", "this project is licensed under the mit license"),
    ("mit-title", "mit license"),
    ("mit-title", "the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-name", "licensed under the apache license version 2 0"),
    ("apache-name", "licensed under the apache license version 2 0 the license"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("gpl2-name", "this work is licensed under the gnu general public license version 2"),
    ("gpl3-name", "this work is licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("ccbync4-name", "licensed under cc by nc 4 0"),
    ("ccby4-name", "licensed under cc by 4 0"),
    ("ccbysa4-name", "licensed under cc by sa 4 0"),
    ("ccbync4-full", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("ccby4-full", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("rights", "all rights reserved"),
)
#: fixed values: licence, identifiers that must occur in this order; earlier rules go first
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title", "as-is")),
    ("MIT", ("mit-name",)),
    ("Apache-2.0", ("apache-name", "apache-use")),
    ("Apache-2.0", ("apache-name",)),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-name",)),
    ("GPL-2.0", ("gpl2-name",)),
    ("CC-BY-NC-4.0", ("ccbync4-full",)),
    ("CC-BY-NC-4.0", ("ccbync4-name",)),
    ("CC-BY-SA-4.0", ("ccbysa4-name",)),
    ("CC-BY-4.0", ("ccby4-full",)),
    ("CC-BY-4.0", ("ccby4-name",)),
    ("proprietary", ("rights",)),
)
#: every sentence holds one of these inside a word, so that a text without them needs no cutting
CUES = ("licen", "permi", "warrant", "redistribut", "rights")
assert all(any(c in s for c in CUES) for _, s in SENTENCES)


def has_cue(low: Column) -> Column:
    found = F.lit(False)
    for cue in CUES:
        found = found | F.contains(low, F.lit(cue))
    return found


#: what may stand before each line of a comment
PREFIX = r"[ \t]*(?:[*#/;%!|<>-]+|(?:REM|rem|dnl)(?=[ \t]))[ \t]*"
SOFT, HARD = "\u0001", "\u0002"


def marked_words(text: Column) -> Column:
    """Words and digits in lower case with one character between two of them and at both ends: a blank inside a line,
    ``SOFT`` where a sentence may begin, end or go on, ``HARD`` where it must end.

    Full stops, exclamation and question marks before white space and blank lines are hard; semicolons, colons and line
    breaks are soft. A break after a comma, or between two letters in lower case, is a blank. A line of a comment's
    prefix alone is blank; before other words the prefix goes.
    """
    steps = ((r"(?m)^" + PREFIX + r"\r?$", ""), (r",[ \t]*\r?\n[ \t]*(?:" + PREFIX + r")?(?=\S)", ", "), (r"(?<=[a-z])[ \t]*\r?\n[ \t]*(?=[a-z])", " "),
             (r"(^|\n)" + PREFIX, "$1"), (r"\n[ \t\r]*\n\s*", HARD), (r"[.!?]\s+", HARD), (r"[;:]\s+|\n", SOFT))
    out = F.translate(text, SOFT + HARD, "  ")
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    out = F.regexp_replace(F.lower(out), f"[^a-z0-9{SOFT}{HARD}]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, f" ?{SOFT}[ {SOFT}]*", SOFT), f"[ {SOFT}]?{HARD}[ {SOFT}{HARD}]*", HARD)
    return F.concat(F.lit(HARD), F.trim(out), F.lit(HARD))


def sentences_of(text: Column, sentences) -> Column:
    """The known sentences of a text in order, each from one mark to another, over any soft marks; the longest first."""
    known = "|".join(s.replace(" ", f"[ {SOFT}]") for s in sorted({s for _, s in sentences}, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(marked_words(text), F.lit(f"(?<=[{SOFT}{HARD}])(?:{known})(?=[{SOFT}{HARD}])"), 0)
    return F.transform(found, lambda x: F.translate(x, SOFT, " "))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """``id, n_sentences, sentence_ids, licence, licences`` of every row.

    ``sentence_ids``: identifiers of the known sentences in text order, comma-joined. ``licences``: names of all rules
    that match, each once, in rule order; ``licence``: the first of them, else null. The identifiers of a rule must
    occur in its order; others may stand between.

    A null or empty text has no sentences, empty strings and a null licence. Every row gives one row, whatever its id;
    only the two named columns are read. All of it runs inside the scan: nothing is shuffled.
    """
    known = F.create_map(*[F.lit(x) for i, s in sentences for x in (s, i)])
    cued = has_cue(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    ids = F.filter(F.transform(sentences_of(F.col(text_col), sentences), lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    found = docs.select(F.col(id_col).alias(id_col), F.when(cued, ids).otherwise(F.array().cast("array<string>")).alias("_ids"))
    seq = F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(","))
    hits = F.array(*[F.when(seq.rlike("," + ",(.*,)?".join(parts) + ","), F.lit(name)) for name, parts in rules])
    return (found.withColumn("_hits", F.array_distinct(F.array_compact(hits)))
            .select(id_col, F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"),
                    F.try_element_at("_hits", F.lit(1)).alias("licence"), F.array_join("_hits", ",").alias("licences")))
