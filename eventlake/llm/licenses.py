r"""License scans by ordered signature rules (operator 9), native DataFrame operations only.

Texts become lower-case words joined by one space.  A document tries a rule's regex only if it holds the literals that every match
of the regex holds, those of its form and one of its name's, so that the prefilter loses no match.  Detections are intervals of the
word text.  One that lies inside another of the same or a higher priority is
suppressed (of equal intervals the higher priority stays, then the earlier rule), which a single pass over the intervals by start decides.

Contract: a null text is "".  Each row gives one row, repeated rows too; other columns are not
read.  ``n_base`` counts places where a base phrase's words stand consecutively; ``first_word`` and
``last_word`` are their smallest and largest start, in words from 0, else null.  ``labels`` has the base labels
and those of the surviving detections.  ``score`` is the weight of the strongest surviving detection, 0 without any.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.url_filter import lower_ascii

#: The phrases that count as base places, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label, literals, regex of the name, SPDX words.  Every match of the name, with the space before and after it, holds one of the literals.
FAMILIES = [
    ("mit", " mit ", r"mit", r"mit"),
    ("mit-0", " mit no attribution ", r"mit no attribution", r"mit 0"),
    ("apache-2", " apache ", r"apache (?:software )?(?:license )?(?:version |v )?2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", " apache ", r"apache (?:software )?(?:license )?(?:version )?1 1", r"apache 1 1"),
    ("bsd-2-clause", " bsd | freebsd ", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", r"bsd 2 clause"),
    ("bsd-3-clause", " bsd ", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", r"bsd 3 clause"),
    ("bsd-4-clause", " bsd ", r"(?:bsd 4 clause|4 clause bsd|original bsd)", r"bsd 4 clause"),
    ("0bsd", " bsd | 0bsd ", r"(?:0bsd|zero clause bsd|bsd zero clause)", r"0bsd"),
    ("bsd", " bsd ", r"bsd", r"bsd"),
    ("gpl-1", " gpl | general public license ", r"(?:gnu )?(?:general public license|gpl) (?:version |v )?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", " gpl| general public license", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", " gpl| general public license", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl", " gpl | gnu general public license ", r"(?:gnu general public license|gnu gpl|gpl)", r"gpl"),
    ("lgpl-2", " lgpl| library general public license", r"(?:gnu )?(?:library general public license|lgpl) ?(?:version |v ?)?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", " lgpl| lesser general public license", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", " lgpl| lesser general public license", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", " lgpl | gnu lesser general public license ", r"(?:gnu lesser general public license|gnu lgpl|lgpl)", r"lgpl"),
    ("agpl-3", " agpl| affero general public license", r"(?:gnu )?(?:affero general public license|agpl) ?(?:version |v ?)?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", " agpl | gnu affero general public license ", r"(?:gnu affero general public license|gnu agpl|agpl)", r"agpl"),
    ("gfdl", " free documentation license ", r"(?:gnu )?free documentation license(?: version 1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", " mpl| mozilla public license", r"(?:mozilla public license|mpl) ?(?:version |v )?1 1", r"mpl 1 1"),
    ("mpl-2", " mpl| mozilla public license", r"(?:mozilla public license|mpl) ?(?:version |v )?2(?: 0)?", r"mpl 2 0"),
    ("epl-1", " epl| eclipse public license", r"(?:eclipse public license|epl) ?(?:version |v )?1(?: 0)?", r"epl 1 0"),
    ("epl-2", " epl| eclipse public license", r"(?:eclipse public license|epl) ?(?:version |v )?2(?: 0)?", r"epl 2 0"),
    ("cddl", " cddl | common development and distribution license ", r"(?:common development and distribution license|cddl)(?: (?:version )?1 [01])?", r"cddl 1 [01]"),
    ("cpl", " common public license ", r"common public license(?: (?:version )?1 0)?", r"cpl 1 0"),
    ("eupl", " eupl | european union public licen", r"(?:european union public licen[cs]e|eupl)(?: (?:version |v )?1 [012])?", r"eupl 1 [012]"),
    ("artistic-2", " artistic license ", r"artistic license (?:version )?2(?: 0)?", r"artistic 2 0"),
    ("artistic", " artistic ", r"artistic(?: license)?", r"artistic 1 0"),
    ("isc", " isc ", r"isc", r"isc"),
    ("zlib", " zlib ", r"zlib", r"zlib"),
    ("boost", " bsl | boost software license ", r"(?:boost software license|bsl)(?: (?:version )?1 0)?", r"bsl 1 0"),
    ("unlicense", " unlicense ", r"unlicense", r"unlicense"),
    ("wtfpl", " wtfpl ", r"wtfpl", r"wtfpl"),
    ("postgresql", " postgresql ", r"postgresql", r"postgresql"),
    ("python-2", " python ", r"python (?:software foundation )?(?:license )?(?:version )?2(?: 0)?", r"python 2 0"),
    ("openssl", " openssl ", r"openssl", r"openssl"),
    ("ofl-1.1", " ofl | open font license ", r"(?:sil )?(?:open font license|ofl)(?: (?:version )?1 1)?", r"ofl 1 1"),
    ("odbl", " odbl | open database license ", r"(?:open database license|odbl)(?: (?:version |v )?1 0)?", r"odbl 1 0"),
    ("cc0", " cc0 | cc zero | creative commons zero ", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?", r"cc0 1 0"),
    ("cc-by", " cc by | creative commons attribution ", r"(?:cc by|creative commons attribution)(?: [1-4] [05])?", r"cc by [1-4] [05]"),
    ("cc-by-sa", " cc by sa | creative commons attribution share", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", " cc by nd | creative commons attribution no", r"(?:cc by nd|creative commons attribution no ?derivatives)(?: [1-4] [05])?", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", " cc by nc | creative commons attribution non", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", " cc by nc sa | creative commons attribution non", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", " cc by nc nd | creative commons attribution non", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives)(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]"),
    ("proprietary", " all rights reserved ", r"all rights reserved", r"proprietary"),
    ("public-domain", " the public domain ", r"(?:dedicated to|placed in|in) the public domain", r"public domain"),
]
#: kind, priority, weight, literal of every match, template; {n}: the name, {s}: the SPDX words.
FORMS = [
    ("identifier", 3, 1.0, " spdx license identifier ", r"spdx license identifier {s}"),
    ("grant", 3, 0.95, " under the ", r"(?:licensed|released|distributed|available|published|provided|covered) under the (?:terms (?:and conditions )?of the )?{n}(?: license)?(?: version [0-9]+)?"),
    ("short-grant", 3, 0.9, " under ", r"(?:licensed|released|distributed|available|published) under (?:a |an )?{n}(?: license)?"),
    ("title", 2, 0.8, " licen", r"{n} licen[cs]e"),
    ("license-of", 2, 0.7, " licen", r"licen[cs]e {n}"),
    ("see", 2, 0.7, " see the ", r"see the {n} (?:license )?for"),
]
#: Matches of a run.
RUN = 128
#: Names that say enough by themselves.
BARE = ("proprietary", "public-domain", "cc0", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "apache-2", "mpl-2", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "unlicense", "odbl", "gfdl")


#: Sentences of licence texts and notices themselves: label, literal that its rules share, a literal of its own, regex.
BODIES = [
    ("mit", " hereby granted ", " person obtaining a copy ", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("boost", " hereby granted ", " person or organization obtaining ", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", " hereby granted ", " with or without fee ", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", " hereby granted ", " without a written agreement ", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", " redistribut", " in source and binary forms ", r"redistribution and use in source and binary forms(?: of [a-z]+)? with or without modification are permitted"),
    ("bsd-3-clause", " this software ", " endorse or promote products ", r"neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", " this software ", " all advertising materials ", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", " altered source versions ", " altered source versions ", r"altered source versions must be plainly marked as such"),
    ("openssl", " redistribut", " the openssl project ", r"redistributions of any form whatsoever must retain the following acknowledg(?:e)?ment this product includes software developed by the openssl project"),
    ("gpl-2", " redistribut", " gnu general public license ", r"you can redistribute it and or modify it under the terms of (?:version 2 of )?the gnu general public license as published by the free software foundation(?: either)? version 2"),
    ("gpl-3", " redistribut", " gnu general public license ", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3"),
    ("lgpl-2.1", " redistribut", " gnu lesser general public license ", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1"),
    ("lgpl-3", " redistribut", " gnu lesser general public license ", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3"),
    ("agpl-3", " redistribut", " gnu affero general public license ", r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3"),
    ("apache-2", " in compliance with the license ", " apache license ", r"licensed under the apache license version 2(?: 0)? the license you may not use this file except in compliance with the license"),
    ("mpl-2", " source code ", " mozilla public license ", r"this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("bsd", " source code ", " bsd style license ", r"use of this source code is governed by a bsd style license"),
    ("mit", " source code ", " mit style license ", r"use of this source code is governed by an? mit style license"),
    ("epl-2", " made available under ", " eclipse public license ", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("cddl", " the contents of this file ", " common development and distribution license ", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", " public domain", " unencumbered software ", r"this is free and unencumbered software released into the public domain"),
    ("cc0", " possible under law ", " waived all copyright ", r"to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright"),
    ("wtfpl", " public license", " you want to public license ", r"do what the (?:fuck|f[^ ]*) you want to public license"),
    ("artistic", " under the same terms as ", " perl ", r"redistribute it and or modify it under the same terms as perl itself"),
    ("python-2", " hereby grants ", " psf ", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ofl-1.1", " under the ", " font software ", r"this font software is licensed under the sil open font license version 1 1"),
    ("proprietary", " strictly prohibited ", " unauthorized copying ", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", " proprietary ", " confidential ", r"(?:proprietary and confidential|confidential and proprietary)"),
]


@dataclass(frozen=True)
class Rule:
    """One signature; ``regex`` matches whole words of the word text, without the space before it.

    A text with a match holds all ``keywords`` and at least one of ``names``.
    """

    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    names: tuple[str, ...]
    regex: str


def signature_rules() -> list[Rule]:
    """Every family in every form, the sentences of licence texts, then the bare names: priority first, then the order of the tables."""
    rules = []
    for kind, priority, weight, key, form in FORMS:
        for label, names, name, spdx in FAMILIES:
            regex = "(?<= )" + form.format(n=f"(?:{name})", s=f"(?:{spdx})") + "(?= )"
            rules.append(Rule(label, priority, weight, (key,), (key,) if kind == "identifier" else tuple(names.split("|")), regex))
    rules += [Rule(label, 3, 1.0, (key,), (name,), f"(?<= ){regex}(?= )") for label, key, name, regex in BODIES]
    return rules + [Rule(label, 1, 0.6, (), tuple(names.split("|")), f"(?<= )(?:{name})(?= )") for label, names, name, _ in FAMILIES if label in BARE]


#: A text without any of these has no match of any rule.
ANCHORS = tuple(dict.fromkeys(n for r in signature_rules() for n in r.names))


def word_text(text: Column) -> Column:
    """`` w1 w2 .. wn `` with one space around and between the words; two spaces for no words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), NO_WORD, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base_columns(words: Column) -> dict[str, Column]:
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        padded = f" {phrase} "
        has = F.contains(words, F.lit(padded))
        counts.append(F.when(has, F.regexp_count(words, F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)))
        firsts.append(F.when(has, _spaces(F.substring(words, F.lit(1), F.instr(words, padded))) - 1))
        start = F.length(words) - F.instr(F.reverse(words), padded[::-1]) - len(padded) + 2
        lasts.append(F.when(has, _spaces(F.substring(words, F.lit(1), start)) - 1))
        labels.append(F.when(has, F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_compact(F.array(*labels)),
    }


def _rules_literal(rules: list[Rule]) -> Column:
    one = lambda i, r: F.struct(F.lit(i).alias("id"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.array(*map(F.lit, r.keywords)).cast("array<string>").alias("keywords"), F.array(*map(F.lit, r.names)).alias("names"), F.lit(r.regex).alias("regex"))
    return F.array(*(one(i, r) for i, r in enumerate(rules)))


def _holds_any(words: Column, literals: Iterable[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(words, F.lit(x)) for x in dict.fromkeys(literals)), F.lit(False))


def gate(words: Column, rules: list[Rule]) -> Column:
    """False only for texts that no rule matches."""
    bare, formed = [r for r in rules if not r.keywords], [r for r in rules if r.keywords]
    by_form = _holds_any(words, (k for r in formed for k in r.keywords[:1])) & _holds_any(words, (n for r in formed for n in r.names))
    return _holds_any(words, (n for r in bare for n in r.names)) | by_form


def detections(words: Column, rules: list[Rule]) -> Column:
    """All matches of all rules by start, longer and higher ones first: start, -end, -priority, id, label, weight."""
    literals = F.array(*map(F.lit, dict.fromkeys(x for r in rules for x in (*r.keywords, *r.names)))).cast("array<string>")
    held = F.array(F.filter(literals, lambda x: F.contains(words, x)))  # one element, so that it is evaluated once and not for each rule
    tried = F.flatten(F.transform(held, lambda h: F.filter(_rules_literal(rules), lambda r: F.arrays_overlap(r["names"], h) & F.forall(r["keywords"], lambda k: F.array_contains(h, k)))))
    fitting = F.filter(tried, lambda r: F.rlike(words, r["regex"]))

    def places(rule: Column) -> Column:
        found = F.regexp_extract_all(words, rule["regex"], F.lit(0))
        pieces = F.split(words, rule["regex"], -1)
        nothing = F.array().cast("array<struct<start:int,back:int>>")
        zero = lambda: F.struct(F.lit(0).alias("at"), nothing.alias("out"))

        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["pieces"])
            end = start + F.length(pair["found"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), (-end).alias("back")))).alias("out"))

        # Appending copies an array, so places are first built in runs of ``RUN`` matches, each from 0, and then moved by the runs before.
        pairs = F.filter(F.arrays_zip(pieces.alias("pieces"), found.alias("found")), lambda p: p["found"].isNotNull())

        def runs_of(p: Column) -> Column:
            starts = F.when(F.size(p) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(RUN)))
            return F.transform(starts, lambda i: F.aggregate(F.slice(p, i, RUN), zero(), step))

        runs = F.flatten(F.transform(F.array(pairs), runs_of))  # one element, so that the regex runs once and not for each use
        moved = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,back:int>>>").alias("out"))

        def move(state: Column, run: Column) -> Column:
            here = F.transform(run["out"], lambda p: F.struct((p["start"] + state["at"]).alias("start"), (p["back"] - state["at"]).alias("back")))
            return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["out"], F.array(here)).alias("out"))

        spans = F.flatten(F.aggregate(runs, moved, move, lambda s: s["out"]))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["back"].alias("back"), (-rule["priority"]).alias("down"), rule["id"].alias("id"), rule["label"].alias("label"), rule["weight"].alias("weight")))

    return F.sort_array(F.flatten(F.transform(fitting, places)))


def surviving(found: Column) -> Column:
    """Struct of labels and the greatest weight after containment suppression.  e1..e3: furthest end so far of each priority or higher."""
    none = F.lit(-1)
    zero = F.struct(none.alias("e1"), none.alias("e2"), none.alias("e3"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))

    def step(s: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["down"]
        covered = F.when(priority == 3, s["e3"]).when(priority == 2, s["e2"]).otherwise(s["e1"]) >= end
        reach = lambda c, p: F.when(priority >= p, F.greatest(s[c], end)).otherwise(s[c]).alias(c)
        labels = F.when(covered, s["labels"]).otherwise(F.array_union(s["labels"], F.array(d["label"])))
        weight = F.when(covered, s["weight"]).otherwise(F.greatest(s["weight"], d["weight"]))
        return F.struct(reach("e1", 1), reach("e2", 2), reach("e3", 3), labels.alias("labels"), weight.alias("weight"))

    return F.aggregate(found, zero, step, lambda s: F.struct(s["labels"].alias("labels"), s["weight"].alias("weight")))


def scan_licenses(df: DataFrame, id_col: str, text_col: str, rules: list[Rule] | None = None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rules = signature_rules() if rules is None else rules
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = df.select(F.col(f"`{id_col}`"), word_text(text).alias("_words"))
    w = F.col("_words")
    empty = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))
    first = words.withColumns(_base_columns(w)).withColumn("n_words", F.when(w == "  ", F.lit(0)).otherwise(_spaces(w) - 1).cast("long"))
    found = first.withColumn("found", F.when(gate(w, rules), surviving(detections(w, rules))).otherwise(empty))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return found.select(
        F.col(f"`{id_col}`"), "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.array_union("base", "found.labels")).alias("labels"),
        F.col("found.weight").alias("score"),
    )
