"""License scan: ordered signature rules behind a keyword prefilter.

One pass over a text finds which keywords occur (an Aho-Corasick automaton); only rules of those keywords run. Their hits
are ordered by priority, then length, then place, and a hit is dropped when its interval lies inside one that is already
kept, so a specific statement hides the general ones inside it. Labels that three base phrases give are always kept.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned each; texts are scanned
whole, whatever their length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm.license_rules import rules
from cohortlens.llm.tables import text_of

#: Base phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
BASE_CONFIDENCE = 0.9
#: Bytes that are not part of a word become blanks.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Scanner:
    """Compiled rules; built once per task."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.rules = [(r, re.compile(r.pattern, re.S)) for r in rules()]
        by_keyword: dict[str, list[int]] = {}
        for i, (r, _) in enumerate(self.rules):
            by_keyword.setdefault(r.keyword, []).append(i)
        for keyword, own in by_keyword.items():
            self.automaton.add_word(keyword, tuple(own))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of the kept detections, in order of place."""
        wanted = sorted({i for _, own in self.automaton.iter(text) for i in own})
        found = [(m.start(), m.end(), i) for i in wanted for m in self.rules[i][1].finditer(text)]
        return sorted(suppress(found, [r.priority for r, _ in self.rules]))


def suppress(found: list[tuple[int, int, int]], priority: list[int]) -> list[tuple[int, int, int]]:
    """Keep hits by priority, length and place; drop one that lies inside a kept interval.

    A hit lies inside a kept one if, of the kept that start no later, the furthest end reaches its own: a running maximum
    over start ranks, held in a binary indexed tree.
    """
    rank = {s: i + 1 for i, s in enumerate(sorted({h[0] for h in found}))}
    furthest = [-1] * (len(rank) + 1)
    kept = []
    for hit in sorted(found, key=lambda h: (-priority[h[2]], h[0] - h[1], h)):
        at, reach = rank[hit[0]], -1
        while at:
            reach, at = max(reach, furthest[at]), at & (at - 1)
        if reach >= hit[1]:
            continue
        kept.append(hit)
        at = rank[hit[0]]
        while at < len(furthest):
            furthest[at] = max(furthest[at], hit[1])
            at += at & -at
    return kept


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every base phrase."""
    out = []
    for i, w in enumerate(words):
        if w == b"license":
            for phrase, label in BASE.items():
                at = i - len(phrase) + 1
                if at >= 0 and tuple(x.decode() for x in words[at : i + 1]) == phrase:
                    out.append((at, label))
    return sorted(out)


def _scan(batches):
    scanner = Scanner()
    detection = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(detection)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for text in batch.column("text").to_pylist():
            lower = text.translate(LOWER)
            words = lower.encode().translate(WORD_BYTES).split(b" ")
            words = [w for w in words if w]
            base = base_places(words) if "license" in lower else []
            own = sorted({label for _, label in base})
            hits = [(scanner.rules[i][0], a, b) for a, b, i in scanner.hits(lower)]
            labels = sorted({*own, *(r.label for r, _, _ in hits)})
            score = max([BASE_CONFIDENCE] * bool(base) + [r.confidence for r, _, _ in hits], default=0.0)
            row = (
                len(words),
                len(base),
                base[0][0] if base else None,
                base[-1][0] if base else None,
                ",".join(own),
                ",".join(labels),
                score,
                [{"label": r.label, "kind": r.kind, "first": a, "end": b} for r, a, b in hits],
            )
            for column, x in zip(columns, row):
                column.append(x)
        yield pa.record_batch(
            [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", *names]
        )


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, labels, score and the kept detections (label, kind, character range)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(
        _scan,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
        " labels string, score double, detections array<struct<label:string,kind:string,first:bigint,end:bigint>>",
    )
