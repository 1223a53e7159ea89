import re
from re import _parser

import pytest

from eventlake.llm import licenses, queries

RULES = licenses.signature_rules()


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    spaced = f" {' '.join(words)} "
    found = []
    if any(a in spaced for a in licenses.ANCHORS):
        for i, rule in enumerate(RULES):
            if all(k in spaced for k in rule.keywords):
                found += [(m.start(), -m.end(), -rule.priority, i) for m in re.finditer(rule.regex, spaced)]
    kept = []
    for n, (start, back, down, i) in enumerate(sorted(found)):
        if not any(s <= start and b <= back and d <= down for s, b, d, _ in sorted(found)[:n]):
            kept.append(i)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    labels = base | {RULES[i].label for i in kept}
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((RULES[i].weight for i in kept), default=0.0))


TEXTS = [
    None, "", " ,.;", "Released under the MIT License.", "x y Licensed under the Apache License, Version 2.0. under the mit license cc-by-nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "mit der Lizenz license", "SPDX-License-Identifier: LGPL-2.1-or-later",
    "Licensed under CC BY-NC-SA 4.0; see the BSD 3-Clause license for more. All rights reserved. Copyright.", "under the MIT licensé", "a under the mit license under the mit license b",
    "UNDER THE MIT LICENSE " * 400, "long " * 30000 + "apache license version 2", "É under\x00the_mit-license", "placed in the public domain, license unlicense gpl v2 see the mpl 2.0 license for",
]


def test_against_brute(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "again"), (None, TEXTS[3], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.scan_licenses(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute(TEXTS[3 if r.doc_id is None else r.doc_id]), r.doc_id
    assert licenses.scan_licenses(df.limit(0), "doc_id", "text").count() == 0


def test_rules():
    assert len(RULES) > 200
    for rule in RULES:
        re.compile(rule.regex)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    query = queries.op9_licenses(spark, folder)
    assert not re.search("Python|Pandas|Arrow|Exchange", query._jdf.queryExecution().toString())
    texts = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    for r in query.collect():
        assert tuple(r)[1:] == brute(texts[r.doc_id])


def ungated(text):
    """Labels and score by all regexes, without any literal."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spaced = f" {' '.join(words)} "
    found = sorted((m.start(), -m.end(), -rule.priority, i) for i, rule in enumerate(RULES) for m in re.finditer(rule.regex, spaced))
    kept = [i for n, (start, back, down, i) in enumerate(found) if not any(s <= start and b <= back and d <= down for s, b, d, _ in found[:n])]
    labels = {RULES[i].label for i in kept} | {label for phrase, label in licenses.BASE.items() if f" {phrase} " in spaced}
    return ",".join(sorted(labels)), max((RULES[i].weight for i in kept), default=0.0)


def test_prefilter_loses_no_match(spark):
    """Rules fire without the word license or a family's long name, and so do all SPDX ids."""
    few = {
        "released under GPL v2": "gpl-2", "distributed under the MPL 2.0": "mpl-2", "available under the BSD 3-clause": "bsd-3-clause", "this code is AGPLv3": "agpl-3", "cc0": "cc0", "see the GPL for details": "gpl",
        "SPDX-License-Identifier: GFDL-1.3-or-later": "gfdl", "SPDX-License-Identifier: CPL-1.0": "cpl", "SPDX-License-Identifier: proprietary": "proprietary",
    }
    texts = [*few, *TEXTS, *(r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect())]
    texts += [f"SPDX-License-Identifier: {re.sub(r'\[(.).*?\]', r'\1', spdx.split('(')[0])}" for _, _, _, spdx in licenses.FAMILIES]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    for r in got:
        assert (r.labels, r.score) == ungated(texts[r.doc_id]), texts[r.doc_id]
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)[: len(few)]] == list(few.values())
    assert all(r.score == 1.0 for r in got if r.doc_id >= len(texts) - len(licenses.FAMILIES))


def strings(parsed):
    """All texts of a parsed regex; [0-9]+ is one digit."""
    out = [""]
    for kind, value in parsed:
        if kind is _parser.LITERAL:
            more = [chr(value)]
        elif kind is _parser.NOT_LITERAL:
            more = ["x"]
        elif kind is _parser.IN:
            more = [chr(x) for k, v in value for x in ([v] if k is _parser.LITERAL else [v[0]])]
        elif kind is _parser.BRANCH:
            more = [t for b in value[1] for t in strings(b)]
        elif kind is _parser.SUBPATTERN:
            more = strings(value[3])
        elif kind is _parser.MAX_REPEAT:
            more = ([""] if value[0] == 0 else []) + strings(value[2])
        else:
            assert kind is _parser.ASSERT
            continue
        out = [a + b for a in out for b in more]
    return out


def test_literals_are_in_every_match():
    for rule in RULES:
        for text in strings(_parser.parse(rule.regex)):
            assert all(k in f" {text} " for k in rule.keywords) and any(n in f" {text} " for n in rule.names), (rule, text)


BODY_TEXTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl,gpl-3",
    "To the extent possible under law, A. Author has waived all copyright": "cc0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Unauthorized copying of this file, via any medium, is strictly prohibited": "proprietary",
}


def test_licence_bodies(spark):
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(BODY_TEXTS)), "doc_id long, text string"), "doc_id", "text").collect()
    for r in got:
        text = list(BODY_TEXTS)[r.doc_id]
        assert (r.labels, r.score) == ungated(text) and r.score == 1.0
        assert set(BODY_TEXTS[text].split(",")) & set(r.labels.split(",")), (text, r.labels)


def test_prefilter_gates(spark):
    """Of documents without any licence words hardly one is searched, and of a mention of one family few rules are tried."""
    words = licenses.word_text(licenses.F.col("text"))
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    clean = [(r.score == 0, r.searched) for r in licenses.scan_licenses(docs, "doc_id", "text").join(docs.select("doc_id", licenses.gate(words, RULES).alias("searched")), "doc_id").collect()]
    assert sum(searched for none, searched in clean if none) <= 0.05 * sum(none for none, _ in clean)
    spaced = " this is released under the mit license "
    tried = [r for r in RULES if all(k in spaced for k in r.keywords) and any(n in spaced for n in r.names)]
    assert 0 < len(tried) < len(RULES) / 20
