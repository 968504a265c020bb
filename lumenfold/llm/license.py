"""License scans by ordered signature rules, as Column expressions only.

Texts are reduced to their words with one blank between them.  A keyword prefilter decides which families of rules are
tried at all; every rule is a regular expression over the words, with a priority and a confidence.  Detections are
intervals of words.  One that another contains is suppressed, and of equal intervals the rule of the better (lower)
priority stays.  A text's detections are found row by row, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that every scan reports, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Families: label, beginnings of words of which a text must hold one (each name has one of them), and the license's
# names over blank-separated lower-case words.
FAMILIES = [
    ("mit", "mit|expat", r"mit|expat|mit x11"),
    ("apache-1.1", "apache|asl", r"apache(?: software)?(?: license)?(?: version)? v?1 1"),
    ("apache-2", "apache|asl", r"apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?|apache2|asl 2 0"),
    ("bsd-2-clause", "bsd|freebsd|0bsd|berkeley", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd"),
    ("bsd-3-clause", "bsd|freebsd|0bsd|berkeley", r"bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd"),
    ("bsd-4-clause", "bsd|freebsd|0bsd|berkeley", r"bsd 4 clause|4 clause bsd|original bsd|old bsd"),
    ("bsd", "bsd|freebsd|0bsd|berkeley", r"bsd(?: style)?|berkeley software distribution"),
    ("0bsd", "bsd|freebsd|0bsd|berkeley", r"0bsd|bsd zero clause|zero clause bsd"),
    ("gpl-1", "gpl|gnu", r"gpl v?1(?: 0)?|gnu general public licen[sc]e(?: version)? v?1"),
    ("gpl-2", "gpl|gnu", r"gpl v?2(?: 0)?|gplv2|gnu general public licen[sc]e(?: version)? v?2|gnu gpl(?: version)? v?2"),
    ("gpl-3", "gpl|gnu", r"gpl v?3(?: 0)?|gplv3|gnu general public licen[sc]e(?: version)? v?3|gnu gpl(?: version)? v?3"),
    ("gpl", "gpl|gnu", r"gnu gpl|gpl|gnu general public"),
    ("lgpl-2.1", "lgpl|gnu", r"lgpl v?2 1|lgplv2 1|gnu lesser general public licen[sc]e(?: version)? v?2 1"),
    ("lgpl-3", "lgpl|gnu", r"lgpl v?3(?: 0)?|lgplv3|gnu lesser general public licen[sc]e(?: version)? v?3"),
    ("lgpl", "lgpl|gnu", r"gnu lgpl|lgpl|gnu lesser general public|gnu library general public"),
    ("agpl-3", "agpl|gnu|affero", r"agpl v?3(?: 0)?|agplv3|gnu affero general public licen[sc]e(?: version)? v?3"),
    ("agpl", "agpl|gnu|affero", r"gnu agpl|agpl|gnu affero general public|affero general public"),
    ("mpl-1.1", "mpl|mozilla", r"mpl 1 1|mozilla public licen[sc]e(?: version)? v?1 1"),
    ("mpl-2", "mpl|mozilla", r"mpl v?2(?: 0)?|mozilla public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("mpl", "mpl|mozilla", r"mozilla public|mpl"),
    ("epl-1", "epl|eclipse", r"epl 1 0|eclipse public licen[sc]e(?: version)? v?1(?: 0)?"),
    ("epl-2", "epl|eclipse", r"epl 2 0|eclipse public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("cddl", "cddl|common", r"cddl(?: v?1 [01])?|common development and distribution"),
    ("eupl", "eupl|european", r"eupl(?: v?1 [12])?|european union public"),
    ("isc", "isc|internet systems", r"isc|internet systems consortium"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("bsl-1", "boost|bsl", r"boost software(?: licen[sc]e)?(?: version)?(?: v?1 0)?|bsl 1 0"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl|do what", r"wtfpl|do what the fuck you want to public"),
    ("artistic-2", "artistic", r"artistic(?: licen[sc]e)? 2(?: 0)?"),
    ("artistic", "artistic", r"perl artistic|artistic"),
    ("ofl-1.1", "ofl|sil", r"ofl(?: v?1 1)?|sil open font"),
    ("psf-2", "psf|python", r"psf|python software foundation"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"ncsa|university of illinois ncsa(?: open source)?"),
    ("ms-pl", "ms pl|microsoft", r"ms pl|microsoft public"),
    ("cc0", "cc|creative", r"cc0(?: 1 0)?(?: universal)?|creative commons zero"),
    ("cc-by-nc-nd", "cc|creative", r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc|creative", r"cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "cc|creative", r"cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "cc|creative", r"cc by nd(?: [1-4] [05])?|creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"),
    ("cc-by-sa", "cc|creative", r"cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "cc|creative", r"cc by(?: [1-4] [05])?|creative commons attribution(?: [1-4] [05])?"),
    ("odbl", "odbl|open database", r"odbl(?: v?1 0)?|open database"),
    ("public-domain", "public domain", r"public domain"),
]

# What a rule says around a license's name, with the rule's confidence; earlier ones have the better priority.
FORMS = [
    (r"spdx license identifier (?:{n})(?: only| or later)?", 1.0),
    (r"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:{n})(?: licen[sc]e)?(?: only| or later| or any later version)?", 0.98),
    (r"(?:released|distributed|available|published|provided|redistribut\w+) (?:\w+ )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{n})(?: licen[sc]e)?", 0.95),
    (r"(?:subject to|governed by|covered by|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{n})(?: licen[sc]e)?", 0.9),
    (r"under (?:the )?(?:terms of (?:the )?)?(?:{n})(?: licen[sc]e)?", 0.85),
    (r"(?:{n}) licen[sc]ed?", 0.8),
    (r"licen[sc]e (?:is )?(?:{n})", 0.7),
]

# Wordings of the licenses themselves and of their notices, each with the beginnings of words it needs: label, keywords,
# regular expression over the words, confidence.  They come before all forms.
NAME = r"(?:[^ ]+ ){1,12}"
SIGNATURES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.9),
    ("bsl-1", "permission", r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation", 1.0),
    ("isc", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided", 1.0),
    ("0bsd", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)", 0.95),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 1.0),
    ("ncsa", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software", 1.0),
    ("bsd", "redistribution", r"redistributions? and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd-3-clause", "neither", r"neither the names? of " + NAME + r"nor the names of (?:its|their|the) contributors may be used to endorse or promote products", 1.0),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-2-clause", "redistribution", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", 0.85),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2", "apache", r"apache org licenses license 2 0", 0.95),
    ("apache-2", "apache", r"apache license version 2 0 january 2004", 1.0),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)", 0.9),
    ("gpl-2", "gnu", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", 1.0),
    ("gpl-3", "gnu", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", 1.0),
    ("gpl-2", "gnu", r"gnu general public license version 2 june 1991", 1.0),
    ("gpl-3", "gnu", r"gnu general public license version 3 29 june 2007", 1.0),
    ("gpl-2", "gnu", r"gnu org licenses old licenses gpl 2 0", 0.95),
    ("gpl-3", "gnu", r"gnu org licenses gpl 3 0", 0.95),
    ("gpl", "gnu", r"see the gnu general public license for more details", 0.8),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license along with", 0.85),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license as published by the free software foundation either version 2 1", 1.0),
    ("lgpl-3", "gnu", r"gnu lesser general public license as published by the free software foundation either version 3", 1.0),
    ("lgpl", "gnu", r"gnu library general public license as published by the free software foundation", 0.95),
    ("lgpl", "gnu", r"you should have received a copy of the gnu lesser general public license along with", 0.85),
    ("lgpl-2.1", "gnu", r"gnu org licenses old licenses lgpl 2 1", 0.95),
    ("lgpl-3", "gnu", r"gnu org licenses lgpl 3 0", 0.95),
    ("agpl-3", "gnu", r"gnu affero general public license as published by the free software foundation either version 3", 1.0),
    ("agpl-3", "gnu", r"gnu org licenses agpl 3 0", 0.95),
    ("agpl", "gnu", r"you should have received a copy of the gnu affero general public license along with", 0.85),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2", "mozilla", r"you can obtain one at https? mozilla org mpl 2 0", 0.9),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-1", "eclipse", r"made available under the terms of the eclipse public license v1 0 which accompanies this distribution", 1.0),
    ("epl-2", "eclipse", r"made available under the terms of the eclipse public license (?:v |version )?2 0", 1.0),
    ("epl-1", "eclipse", r"eclipse org legal epl v10", 0.95),
    ("epl-2", "eclipse", r"eclipse org legal epl 2 0", 0.95),
    ("cddl", "common", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("eupl", "european", r"licen[sc]ed under the eupl version 1 [012] or as soon they will be approved by the european commission", 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("zlib", "origin", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unlicense", r"for more information please refer to (?:https? )?unlicense org", 0.9),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 1.0),
    ("ofl-1.1", "sil", r"this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl-1.1", "sil", r"scripts sil org ofl", 0.9),
    ("psf-2", "psf", r"psf license agreement for python", 1.0),
    ("artistic-2", "perlfoundation", r"perlfoundation org artistic license 2 0", 0.95),
    ("artistic", "perl", r"under the same terms as perl itself", 0.9),
    ("ms-pl", "microsoft", r"microsoft public license ms pl", 1.0),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl", 0.95),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 0.95),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0", 0.95),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]", 0.95),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]", 0.95),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]", 0.95),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]", 0.95),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]", 0.95),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]", 0.95),
    ("cc0", "waived", r"has waived all copyright and related or neighbou?ring rights to", 0.9),
    ("public-domain", "dedicat", r"(?:is|are|been) (?:hereby )?dedicated to the public domain", 0.9),
]

# Words without which no rule and no base phrase can match; most texts end here.  LOOSE reads raw texts and spares them
# being cut into words: it holds wherever PREFILTER, which reads the words, does.
WORDINGS = "permission|redistribution|neither|advertising|apache|gnu|altered|origin|unencumbered|unlicense|fuck|sil|perl|creativecommons|opendatacommons|eclipse|waived|dedicat"
LOOSE = r"(?i)licen[sc]|spdx|under|cc|subject|governed|covered|according|" + WORDINGS
PREFILTER = r"licen[sc]| spdx | under | cc | subject to | governed by | covered by | according to | (?:" + WORDINGS + ")"


def rules() -> list[dict]:
    """Wordings, then every family in every form, in order of priority (lower is better): the form first, then the family's place."""
    out = [{"label": label, "keywords": tuple(keywords.split("|")), "priority": i - len(SIGNATURES), "confidence": confidence, "regex": f" (?:{regex})(?= )"} for i, (label, keywords, regex, confidence) in enumerate(SIGNATURES)]
    for i, (form, confidence) in enumerate(FORMS):
        for j, (label, keywords, names) in enumerate(FAMILIES):
            out.append({"label": label, "keywords": tuple(keywords.split("|")), "priority": 1 + i * len(FAMILIES) + j, "confidence": confidence, "regex": f" (?:{form.replace('{n}', names)})(?= )"})
    return out


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def places(words: Column, regex: Column) -> Column:
    """array<struct<start, stop>>: the matches of a regular expression that begins with a blank, in words."""
    found, between = F.regexp_extract_all(words, regex, F.lit(0)), F.split(words, regex, -1)
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + _blanks(x["gap"]) + _blanks(x["hit"])).alias("at"),
        F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + _blanks(x["gap"])).alias("start"), (acc["at"] + _blanks(x["gap"]) + _blanks(x["hit"])).alias("stop"))))).alias("out"),
    )
    pairs = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct(F.element_at(between, i).alias("gap"), F.element_at(found, i).alias("hit")))
    fold = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, fold).otherwise(empty)


def _phrase(words: Column, phrase: str, label: str) -> Column:
    """All places of a phrase: array<struct<start, stop, label>>."""
    at = F.when(F.contains(words, F.lit(f" {phrase} ")), places(words, F.lit(f" {phrase}(?= )"))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    return F.transform(at, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(label).alias("label")))


def _literal(by_keywords: dict[tuple[str, ...], list[dict]]) -> str:
    """The rules as one SQL literal: array<struct<keys, rules>>; thousands of Column calls would take seconds."""
    rule = lambda r: f"named_struct('regex', r'{r['regex']}', 'priority', {r['priority']}, 'label', '{r['label']}', 'confidence', {r['confidence']}D)"
    group = lambda keys, rows: f"named_struct('keys', array({', '.join(repr(' ' + k) for k in keys)}), 'rules', array({', '.join(map(rule, rows))}))"
    return f"array({', '.join(group(k, v) for k, v in by_keywords.items())})"


def _open(words: Column, by_keywords: dict[tuple[str, ...], list[dict]]) -> Column:
    """array<boolean>: which groups of rules have a keyword and a match.  A pattern that is a literal is compiled once, so
    only rules of texts with a match are compiled for a row."""
    any_match = lambda rows: F.regexp_like(words, F.lit("|".join(r["regex"] for r in rows)))
    keyword = lambda keys: reduce(lambda a, b: a | b, [F.contains(words, F.lit(" " + k)) for k in keys])
    return F.array(*[F.when(keyword(keys), any_match(rows)).otherwise(F.lit(False)) for keys, rows in by_keywords.items()])


def _detect(words: Column, some: Column) -> Column:
    """Detections of the rules in an array: array<struct<start, stop, priority, label, confidence>>."""
    tried = F.filter(some, lambda r: F.regexp_like(words, r["regex"]))
    return F.flatten(
        F.transform(
            tried,
            lambda r: F.transform(
                places(words, r["regex"]),
                lambda p: F.struct(p["start"].alias("start"), (-p["stop"]).alias("before"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")),
            ),
        )
    )


DETECTIONS = "array<struct<start:int,before:int,priority:int,label:string,confidence:double>>"


def suppress(found: Column) -> Column:
    """Drop detections inside another: in order of start, then of falling length, then of priority, one whose end an earlier one reaches."""
    none = F.array().cast(DETECTIONS)
    keep = lambda acc, d: F.when(-d["before"] > acc["reach"], F.struct((-d["before"]).alias("reach"), F.concat(acc["out"], F.array(d)).alias("out"))).otherwise(acc)
    return F.aggregate(F.array_sort(found), F.struct(F.lit(-1).alias("reach"), none.alias("out")), keep, lambda acc: acc["out"])


def license_scan(docs: DataFrame) -> DataFrame:
    """Add n_words, base (array of start, stop, label) and detections (array, after suppression) to every row.

    Null texts count as empty: no words, empty arrays.  Rows are independent, so repeated rows, clashing names of
    further columns (n_words, base and detections are replaced) and empty tables need no care.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))
    out = docs.withColumns({"n_words": F.regexp_count(text, F.lit(WORD)).cast("long"), "_words": F.when(F.regexp_like(text, F.lit(LOOSE)), joined)})
    words = F.col("_words")
    out = out.withColumn("_words", F.when(F.regexp_like(words, F.lit(PREFILTER)), words))
    base = F.flatten(F.array(*[_phrase(words, phrase, label) for phrase, label in BASE.items()]))
    by_keywords: dict[tuple[str, ...], list[dict]] = {}
    for r in rules():
        by_keywords.setdefault(r["keywords"], []).append({k: r[k] for k in ("regex", "priority", "label", "confidence")})
    tried = F.transform(F.array(_open(words, by_keywords)), lambda flags: F.flatten(F.transform(F.filter(F.expr(_literal(by_keywords)), lambda g, i: F.get(flags, i)), lambda g: g["rules"])))[0]
    no_base = F.array().cast("array<struct<start:int,stop:int,label:string>>")
    found = F.when(words.isNotNull(), _detect(words, tried)).otherwise(F.array().cast(DETECTIONS))
    out = out.withColumns({"base": F.when(words.isNotNull(), base).otherwise(no_base), "_found": found})
    return out.withColumn("detections", suppress(F.col("_found"))).drop("_words", "_found")


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    scan = license_scan(docs.select("doc_id", "text"))
    base = F.sort_array(F.array_distinct(F.transform("base", lambda x: x["label"])))
    every = F.sort_array(F.array_distinct(F.concat(base, F.transform("detections", lambda x: x["label"]))))
    starts = F.transform("base", lambda x: x["start"])
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)))
    return scan.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
