"""The license scan against plain regular expressions and a quadratic suppression."""

import random
import re

from misheard.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = WORD.findall((text or "").translate(FOLD))
    norm = f" {'  '.join(words)} "
    hits = []
    for r in licenses.RULES:
        for m in re.finditer(r["re"], norm):
            lo, n = norm[: m.start()].count(" ") // 2, m[0].count(" ") // 2
            hits.append((lo, lo + n, r["priority"], r["rule"], r["label"], r["trust"], r["base"]))

    def better(e, h):
        return e[2] < h[2] or e[2] == h[2] and (e[:2] != h[:2] or e[3] < h[3])

    kept = [h for h in hits if h[6] or not any(e[0] <= h[0] and e[1] >= h[1] and better(e, h) for e in hits if e is not h)]
    base = [h for h in kept if h[6]]
    return (
        len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None),
        ",".join(sorted({h[4] for h in base})), ",".join(sorted({h[4] for h in kept})), max((h[5] for h in kept), default=0.0),
    )


SCRAPS = (
    "Licensed under the Apache License, Version 2.0", "CC BY", "cc-by CC By cc_by", "CC BY-NC-SA 4.0", "ALL RIGHTS RESERVED.",
    "GNU General Public License, version 3", "General\nPublic\tLicense", "see the MIT license for", "SPDX-License-Identifier: MIT",
    "SPDX-License-Identifier: GPL-2.0-or-later", "wort mit wort", "accept", "École Ünï ÀB", "GPLv2", "gpl", "2-clause BSD",
    "Redistribution and use in source and binary forms, with or without modification", "licence", "BY CC BY CC", "0", "...",
    "public domain", "https://www.apache.org/licenses/LICENSE-2.0", "under terms of the the GPL v3", "rights all rights reserved",
)


def test_equals_plain_scan(docs_of):
    draw = random.Random(3)
    texts = [None, "", " ", "x", "CC BY", "cc by", *SCRAPS, "all rights reserved " * 700 + "MIT license " * 600]
    texts += [" ".join(draw.choices(SCRAPS, k=draw.randint(1, 12))) for _ in range(150)]
    rows = [(n % 40 if n % 7 else None, t) for n, t in enumerate(texts)]
    got = sorted(map(str, (tuple(r) for r in licenses.digests(docs_of(rows)).collect())))
    assert got == sorted(map(str, ((i, *plain(t)) for i, t in rows)))


def test_empty_table_and_shape(spark, docs_of):
    empty = docs_of([(1, "x")]).where("false")
    assert licenses.digests(empty).collect() == []
    docs = docs_of([(1, "Licensed under CC BY-NC 4.0.")])
    row = licenses.scan(docs).first()
    assert [(h.start, h.end, h.label) for h in row.licenses.hits if not h.base] == [(0, 7, "cc-by-nc-4.0")]
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rules_are_many_and_keyed():
    assert len(licenses.RULES) >= 300
    assert all(r["keys"] or r["label"] for r in licenses.RULES)
