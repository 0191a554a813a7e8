import re

import pytest

from boreflow.llm import licenses as L
from tests.llm.helpers import awkward, frame

BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for k in range(len(words)) for p, label in BASE.items() if tuple(words[k : k + len(p)]) == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


CASES = [
    "Licensed under CC BY 4.0. All rights reserved; ALL RIGHTS RESERVED", "cc by cc by cc by", "GNU Lesser General Public License v3",
    "x" * 50_000 + " all rights reserved", "all rights all rights reserved cc", "ccby cc  by CC-BY, cc\nby", "İstanbul CC BY É",
]


def test_base_columns_by_brute_force(spark):
    rows = awkward() + [(100 + k, t) for k, t in enumerate(CASES)]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_scan(frame(spark, rows)).collect()}
    assert got == {(i, *brute(t)) for i, t, *_ in rows}
    assert L.license_scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("text", "labels", "score"), [
    ("// SPDX-License-Identifier: MIT OR GPL-2.0-only", "gpl-2.0-only,mit", 0.2),
    ("spdx-license-identifier: MIT AND GPL-2.0-only */", "gpl-2.0-only,mit", 0.8),
    ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "gpl-2.0", 0.6),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND (LGPL-2.1", "apache-2.0,lgpl-2.1,mit", 0.5),
    ("SPDX-License-Identifier:", "", 0.0), ("SPDX-License-Identifier: AND MIT", "", 0.0),
    ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0", 0.2), ("nothing here", "", 0.0),
])
def test_labels(text, labels, score):
    got = L.scan(text.encode())
    assert got[5] == labels and got[6] == pytest.approx(score)


def test_precedence():
    assert L.postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert L.postfix("( a or b ) and c".split()) == "a b or c and".split()
    assert L.postfix("a b".split()) == ["a"] and L.postfix([")"]) == [] and L.postfix("( a".split()) == ["a"]
