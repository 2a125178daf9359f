"""License scan: ordered signature rules over the words of whole texts.

A text is lower-cased (A-Z only) and written as its words, each between two spaces of
its own, so that a rule is a regular expression that can neither cut a word nor take
the space its neighbour needs. Texts without any anchor are done with; on the others a
rule runs only where all words that it requires, its keywords, are found.
Each match is an interval of words; one that lies within a match of a better priority,
or of the same priority and earlier in the order (start, longer, rule), is suppressed.
Base phrases are never suppressed and suppress nothing else.

Built of DataFrame functions, one stage, no shuffle: what a text needs depends on that
text alone, so a common license line, source or group of copies burdens no single task.

Null and empty texts have no words and no labels; repeated rows and null ids are
answered one by one; an empty table gives an empty one; other columns of the table,
whatever their names, are not looked at by `digests` and kept by `scan`.
"""

import json

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: base phrases and their labels, in order --------------------
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# --- fixed values: licenses. label; SPDX identifiers; names -------------------
# A pattern is a row of words: `a|b` one of them, a closing `?` may be missing,
# `*3` up to three words of any kind.
LICENSES = (
    ("apache-1.1", ("apache 1 1",), ("apache software? license|licence version|v? 1 1",)),
    ("apache-2.0", ("apache 2 0",), ("apache software? license|licence version|v? 2 0?", "apache license|licence v2|v2 0?")),
    ("mit", ("mit",), ("mit x11? license|licence", "x11 license|licence", "expat license|licence")),
    ("mit-0", ("mit 0",), ("mit no attribution license|licence", "mit 0 license|licence")),
    ("bsd-2-clause", ("bsd 2 clause",), ("bsd 2|two clause license|licence?", "2|two clause bsd license|licence?", "simplified bsd license|licence")),
    ("bsd-3-clause", ("bsd 3 clause",), ("bsd 3|three clause license|licence?", "3|three clause bsd license|licence?", "new|modified|revised bsd license|licence")),
    ("bsd-4-clause", ("bsd 4 clause",), ("original bsd license|licence", "4|four clause bsd license|licence?")),
    ("0bsd", ("0bsd",), ("zero clause bsd license|licence?",)),
    ("isc", ("isc",), ("isc license|licence", "internet systems consortium license|licence")),
    ("gpl-1.0", ("gpl 1 0 only|or?",), ("gnu? general public license|licence version|v? 1 0?", "gpl version|v? 1 0?", "gplv1")),
    ("gpl-2.0", ("gpl 2 0 only|or?",), ("gnu? general public license|licence version|v? 2 0?", "gpl version|v? 2 0?", "gplv2")),
    ("gpl-3.0", ("gpl 3 0 only|or?",), ("gnu? general public license|licence version|v? 3 0?", "gpl version|v? 3 0?", "gplv3")),
    ("lgpl-2.0", ("lgpl 2 0 only|or?",), ("gnu? library general public license|licence version|v? 2 0?", "lgpl version|v? 2 0")),
    ("lgpl-2.1", ("lgpl 2 1 only|or?",), ("gnu? lesser general public license|licence version|v? 2 1", "lgpl version|v? 2 1", "lgplv2 1?")),
    ("lgpl-3.0", ("lgpl 3 0 only|or?",), ("gnu? lesser general public license|licence version|v? 3 0?", "lgpl version|v? 3 0?", "lgplv3")),
    ("agpl-3.0", ("agpl 3 0 only|or?",), ("gnu? affero general public license|licence version|v? 3 0?", "agpl version|v? 3 0?", "agplv3")),
    ("gfdl", ("gfdl 1 1|2|3 only|or?",), ("gnu free documentation license|licence", "gfdl")),
    ("mpl-1.1", ("mpl 1 1",), ("mozilla public license|licence version|v? 1 1",)),
    ("mpl-2.0", ("mpl 2 0",), ("mozilla public license|licence version|v? 2 0?",)),
    ("epl-1.0", ("epl 1 0",), ("eclipse public license|licence version|v? 1 0?",)),
    ("epl-2.0", ("epl 2 0",), ("eclipse public license|licence version|v? 2 0?",)),
    ("cddl-1.0", ("cddl 1 0",), ("common development and distribution license|licence version|v? 1 0?",)),
    ("cpl-1.0", ("cpl 1 0",), ("common public license|licence version|v? 1 0?",)),
    ("eupl-1.2", ("eupl 1 2",), ("european union public license|licence version|v? 1 2",)),
    ("artistic-1.0", ("artistic 1 0",), ("artistic license|licence version|v? 1 0?",)),
    ("artistic-2.0", ("artistic 2 0",), ("artistic license|licence version|v? 2 0?",)),
    ("zlib", ("zlib",), ("zlib license|licence", "zlib libpng license|licence")),
    ("bsl-1.0", ("bsl 1 0",), ("boost software license|licence version|v? 1 0?",)),
    ("psf-2.0", ("psf 2 0",), ("python software foundation license|licence version|v? 2?",)),
    ("unlicense", ("unlicense",), ("the unlicense",)),
    ("wtfpl", ("wtfpl",), ("do what the fuck you want to public license|licence",)),
    ("ofl-1.1", ("ofl 1 1",), ("sil open font license|licence version|v? 1? 1?",)),
    ("odbl-1.0", ("odbl 1 0",), ("open database license|licence version|v? 1? 0?", "open data commons open database license|licence")),
    ("odc-by-1.0", ("odc by 1 0",), ("open data commons attribution license|licence",)),
    ("cc0-1.0", ("cc0 1 0",), ("creative commons zero 1? 0?", "cc0 1? 0?", "cc0 universal")),
)

# --- fixed values: clauses of the attribution licenses ------------------------
CC_CLAUSES = (
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution sharealike"),
    ("by-nd", "by nd", "attribution noderivatives|noderivs"),
    ("by-nc", "by nc", "attribution noncommercial"),
    ("by-nc-sa", "by nc sa", "attribution noncommercial sharealike"),
    ("by-nc-nd", "by nc nd", "attribution noncommercial noderivatives|noderivs"),
)
CC_VERSIONS = ("2 0", "2 5", "3 0", "4 0")

# --- fixed values: forms in which a license is named. priority, trust, pattern --
FORMS = (
    (1, 1.0, "spdx license identifier {id}"),
    (2, 0.95, "licensed|released|distributed|available|published|provided|covered|offered under the? terms? and? conditions? of? the? {name}"),
    (2, 0.95, "subject|according to the? terms? and? conditions? of? the? {name}"),
    (2, 0.9, "governed by the? terms? of? the? {name}"),
    (2, 0.9, "see|read|accept the? {name} for|before|and"),
    (3, 0.85, "license|licence {id}"),
    (3, 0.8, "{name}"),
)

# --- fixed values: sentences of licenses and notices. label, priority, trust, pattern
NOTICES = (
    ("mit", 2, 0.9, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 2, 0.85, "permission to use copy modify and or? distribute this software for any purpose"),
    ("bsd", 2, 0.9, "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", 2, 0.9, "neither the name *6 may be used to endorse or promote products"),
    ("bsd-4-clause", 2, 0.9, "all advertising materials mentioning features or use of this software"),
    ("gpl", 2, 0.9, "this program is free software you can redistribute it and or modify"),
    ("lgpl", 2, 0.9, "this library is free software you can redistribute it and or modify"),
    ("gpl", 3, 0.7, "either version 2|3 of the license or at your option any later version"),
    ("apache-2.0", 2, 0.95, "apache org licenses license 2 0"),
    ("gpl", 2, 0.9, "gnu org licenses gpl"),
    ("lgpl", 2, 0.9, "gnu org licenses lgpl"),
    ("agpl", 2, 0.9, "gnu org licenses agpl"),
    ("gfdl", 2, 0.9, "gnu org licenses fdl"),
    ("mit", 2, 0.95, "opensource org licenses mit"),
    ("bsd", 2, 0.9, "opensource org licenses bsd"),
    ("mpl-2.0", 2, 0.95, "mozilla org mpl|mpl2 2? 0?"),
    ("cc0-1.0", 1, 0.95, "creativecommons org publicdomain zero 1 0"),
    ("unlicense", 2, 0.9, "this is free and unencumbered software released into the public domain"),
    ("public-domain", 3, 0.7, "released|dedicated|placed|given *2 to|into|in the public domain"),
    ("public-domain", 4, 0.5, "public domain"),
    ("zlib", 2, 0.85, "this software is provided as is without any express or implied warranty"),
    ("no-warranty", 4, 0.3, "without warranty of any kind"),
    ("no-warranty", 4, 0.3, "without warranties or conditions of any kind"),
    ("proprietary", 2, 0.8, "proprietary and confidential"),
    ("proprietary", 2, 0.8, "no part of this publication|book|work|document may be reproduced"),
    ("proprietary", 3, 0.7, "may not be reproduced|copied|redistributed without *3 permission"),
    ("copyright", 4, 0.4, "copyright c? *1 by|the"),
    ("apache", 4, 0.6, "apache license|licence"),
    ("gpl", 4, 0.6, "gnu gpl"),
    ("gpl", 4, 0.6, "gnu general public license|licence"),
    ("lgpl", 4, 0.6, "gnu? lesser|library general public license|licence"),
    ("agpl", 4, 0.6, "gnu? affero general public license|licence"),
    ("mpl", 4, 0.6, "mozilla public license|licence"),
    ("bsd", 4, 0.6, "bsd license|licence"),
    ("bsd", 4, 0.6, "bsd style license|licence"),
    ("mit", 4, 0.5, "mit style license|licence"),
    ("epl", 4, 0.6, "eclipse public license|licence"),
    ("artistic", 4, 0.6, "artistic license|licence"),
    ("cc", 4, 0.5, "creative commons license|licence?"),
)

# --- fixed values: anchors. Every rule needs one of them, or `cc by` ----------
ANCHORS = (
    "licen", "rights", "copyright", "permission", "redistribut", "warrant", "advertising", "endorse", "proprietary",
    "reproduced", "domain", "creative", "mozilla", "gpl", "gfdl", "bsd", "cc0",
)

_CC_BY = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"                # of a lower-cased text
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = 5                # priorities 1 to 4, and 5 for base phrases
_BLOCK = 256


def regex(pattern: str) -> str:
    """A pattern of words as a regular expression over words between spaces."""
    out = []
    for token in pattern.split():
        if token[0] == "*":
            out.append(f"(?: [^ ]+ ){{0,{token[1:]}}}")
            continue
        token, optional = token.removesuffix("?"), token.endswith("?")
        words = [f" {w} " for w in token.split("|")]
        out.append((words[0] if len(words) == 1 and not optional else f"(?:{'|'.join(words)})") + "?" * optional)
    return "".join(out)


def required(pattern: str) -> list[str]:
    """The words that every match of a pattern holds: its keywords."""
    return [t for t in pattern.split() if t[0] != "*" and t[-1] != "?" and "|" not in t]


def anchored(pattern: str) -> bool:
    """Whether every match holds an anchor."""
    must = [t.split("|") for t in pattern.split() if t[0] != "*" and t[-1] != "?"]
    return " cc by " in f" {pattern} " or any(all(a in w for w in words) for words in must for a in ANCHORS)


def build_rules() -> list[dict]:
    """All rules in order: every license in every form, then the notices, then the base
    phrases."""
    licenses = list(LICENSES)
    for clause, short, long in CC_CLAUSES:
        for v in CC_VERSIONS:
            dotted = v.replace(" ", ".")
            ids, names = (f"cc {short} {v}",), (f"cc {short} {v}", f"creative commons {long} {v}")
            licenses.append((f"cc-{clause}-{dotted}", ids, names))
        licenses.append((f"cc-{clause}", (), (f"cc {short}", f"creative commons {long}")))
    rules = []

    def add(label: str, priority: int, trust: float, pattern: str, base: bool = False) -> None:
        rules.append({"rule": len(rules), "label": label, "priority": priority, "trust": trust,
                      "re": regex(pattern), "keys": required(pattern), "base": base})
        assert anchored(pattern), pattern

    for label, ids, names in licenses:
        for priority, trust, form in FORMS:
            for word in ids if "{id}" in form else names:
                add(label, priority, trust, form.format(id=word, name=word))
    for label, priority, trust, pattern in NOTICES:
        add(label, priority, trust, pattern)
    for phrase, label in BASE:
        add(label, _LEVELS, 0.6, phrase, True)
    return rules


RULES = build_rules()
KEYWORDS = sorted({k for r in RULES for k in r["keys"]})


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(items: Column, start: Column, kind: str, step) -> Column:
    """A left fold that also gives a list: step(state, item) is (state, array of kept
    items). Blocks keep the cost of growing the list near linear."""
    none = F.array().cast(f"array<{kind}>")
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))
    one = lambda a, x: _let(step(a["state"], x), lambda r: pair(r["state"], F.concat(a["out"], r["out"])))
    many = lambda a, block: _let(
        F.aggregate(block, pair(a["state"], none), one), lambda r: pair(r["state"], F.concat(a["out"], r["out"]))
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")),
        lambda k: F.slice(items, k * _BLOCK + 1, F.lit(_BLOCK)),
    )
    return F.when(F.size(items) == 0, none).otherwise(F.aggregate(blocks, pair(start, none), many)["out"])


def _words_in(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("int")


def spaced_words(text: Column) -> Column:
    """The words of a text, each between two spaces of its own."""
    words = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _NO_WORD, " "))
    return F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))


def _may_match(text: Column) -> Column:
    """Whether a text holds an anchor. Lower-casing by Unicode finds more, never less."""
    return _let(F.lower(text), lambda low: F.exists(
        F.array(*[F.lit(a) for a in ANCHORS]), lambda a: F.contains(low, a)
    ) | F.regexp_like(low, F.lit(_CC_BY)))


_RULE_ARRAY = "array<struct<rule:int,label:string,priority:int,trust:double,re:string,keys:array<string>,base:boolean>>"
_HIT = "struct<start:int,less_end:int,priority:int,rule:int,label:string,trust:double,base:boolean>"


def _hits(norm: Column, rule: Column) -> Column:
    """All matches of one rule: (start, -end, priority, ...), in words from 0."""

    def place(pieces: Column) -> Column:
        found = F.regexp_extract_all(norm, rule["re"], F.lit(0))
        parts = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("match"))

        def step(at: Column, x: Column) -> Column:
            start = at + _words_in(x["gap"])
            end = start + _words_in(x["match"])
            hit = F.struct(
                start.alias("start"), (-end).alias("less_end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"),
                rule["label"].alias("label"), rule["trust"].alias("trust"), rule["base"].alias("base"),
            )
            return F.struct(end.alias("state"), F.array(hit).alias("out"))

        return F.when(F.size(pieces) > 1, _let(parts, lambda p: _fold(p, F.lit(0), _HIT, step))).otherwise(
            F.array().cast(f"array<{_HIT}>")
        )

    return _let(F.split(norm, rule["re"], -1), place)


def _kept(hits: Column) -> Column:
    """Hits in order that no better one contains; base phrases always stay.

    In the order (start, longer, priority, rule) every interval that contains a hit
    comes before it, so the largest end so far of each priority tells."""

    def step(ends: Column, x: Column) -> Column:
        end = -x["less_end"]
        inside = F.array_max(F.slice(ends, F.lit(1), x["priority"])) >= end
        raised = F.transform(ends, lambda e, k: F.when(k + 1 == x["priority"], F.greatest(e, end)).otherwise(e))
        out = F.when(x["base"] | ~inside, F.array(x)).otherwise(F.array().cast(f"array<{_HIT}>"))
        return F.struct(raised.alias("state"), out.alias("out"))

    return _fold(F.array_sort(hits), F.array(*[F.lit(-1)] * _LEVELS), _HIT, step)


def detections(text: Column) -> Column:
    """Kept matches of a text in order."""
    rules = F.from_json(F.lit(json.dumps(RULES)), F.lit(_RULE_ARRAY))
    known = F.array(*[F.lit(k) for k in KEYWORDS])
    none = F.array().cast(f"array<{_HIT}>")

    def hits(norm: Column) -> Column:
        held = F.array_intersect(known, F.split(F.trim(norm), "  "))
        wanted = _let(held, lambda held: F.filter(rules, lambda r: F.forall(r["keys"], lambda k: F.array_contains(held, k))))
        return F.flatten(F.transform(wanted, lambda r: _hits(norm, r)))

    found = F.when(_may_match(text), _let(spaced_words(text), hits))
    return _let(found, lambda h: F.when(F.size(h) > 0, _kept(h)).otherwise(none))


def scan(docs: DataFrame, text_col: str = "text", out: str = "licenses") -> DataFrame:
    """`docs` with a column `out`: n_words, and the kept hits with their word intervals
    (start, end exclusive), label, trust, and whether it is a base phrase."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = _let(detections(text), lambda hits: F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), (-h["less_end"]).alias("end"), h["label"].alias("label"), h["rule"].alias("rule"),
        h["trust"].alias("trust"), h["base"].alias("base"),
    )))
    return docs.withColumn(out, F.struct(F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), hits.alias("hits")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, base places, labels, and a score: the greatest trust of what
    was found, 0 if nothing was."""
    # text alone goes in: other columns may bear any name
    rows = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def digest(hits: Column) -> Column:
        base = F.filter(hits, lambda h: h["base"])
        starts = F.transform(base, lambda h: h["start"].cast("long"))
        names = lambda hs: F.array_join(F.array_sort(F.array_distinct(F.transform(hs, lambda h: h["label"]))), ",")
        return F.struct(
            F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(hits).alias("labels"),
            F.coalesce(F.array_max(F.transform(hits, lambda h: h["trust"])), F.lit(0.0)).alias("score"),
        )

    return rows.select(
        "doc_id", F.col("licenses.n_words").alias("n_words"), _let(F.col("licenses.hits"), digest).alias("d")
    ).select("doc_id", "n_words", "d.*")
