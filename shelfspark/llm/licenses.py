"""License scan by ordered signature rules.

Each rule is a regular expression with a label, a priority and keywords: some two hundred written by hand
(:mod:`license_rules`), and for names with versions, Creative Commons terms and SPDX identifiers one for each form.  One
Aho-Corasick pass over the lower-cased text finds keywords; only rules with a keyword present are run.  Detections are taken in order of priority (then
length, then place); one that lies inside an interval already taken is suppressed, so "gpl-3.0-or-later" is not also
"gpl-3.0" and "gpl".  Base rules match the words of a fixed phrase in a row and are never suppressed.

Defined results: null and empty texts have no words, no detections, empty labels and score 0; rules of equal priority
and length go by place, then label; repeated rows are scanned alike; whole texts are scanned whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfspark.llm._batches import flat, runs, two
from shelfspark.llm.license_rules import SIGNATURES, SPDX

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    base: bool = False


def phrase(words: str) -> str:
    """A pattern for these words in a row, whatever separates them; ``words`` may hold regular expressions without blanks."""
    return rf"(?<!{WORD}){GAP.join(words.split())}(?!{WORD})"


#: Families: label, name pattern, keyword, versions.
FAMILIES = (
    ("agpl", "(?:affero general public licen[sc]e|agpl)", ("affero", "agpl"), ("1.0", "3.0")),
    ("lgpl", "(?:(?:lesser|library) general public licen[sc]e|lgpl)", ("lesser", "library general", "lgpl"), ("2.0", "2.1", "3.0")),
    ("gpl", "(?:general public licen[sc]e|gpl)", ("general public", "gpl"), ("1.0", "2.0", "3.0")),
    ("gfdl", "(?:free documentation licen[sc]e|gfdl)", ("free documentation", "gfdl"), ("1.1", "1.2", "1.3")),
    ("apache", "apache(?: software)?(?: licen[sc]e)?", ("apache",), ("1.0", "1.1", "2.0")),
    ("mpl", "(?:mozilla public licen[sc]e|mpl)", ("mozilla", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", "(?:eclipse public licen[sc]e|epl)", ("eclipse", "epl"), ("1.0", "2.0")),
    ("cddl", "(?:common development and distribution licen[sc]e|cddl)", ("common development", "cddl"), ("1.0", "1.1")),
    ("cpl", "common public licen[sc]e", ("common public",), ("0.5", "1.0")),
    ("eupl", "(?:european union public licen[sc]e|eupl)", ("european union", "eupl"), ("1.0", "1.1", "1.2")),
    ("osl", "(?:open software licen[sc]e|osl)", ("open software", "osl"), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "(?:academic free licen[sc]e|afl)", ("academic free", "afl"), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic licen[sc]e", ("artistic",), ("1.0", "2.0")),
    ("boost", "(?:boost software licen[sc]e|bsl)", ("boost", "bsl"), ("1.0",)),
    ("zpl", "(?:zope public licen[sc]e|zpl)", ("zope", "zpl"), ("1.1", "2.0", "2.1")),
    ("php", "php licen[sc]e", ("php",), ("3.0", "3.01")),
    ("python", "(?:python software foundation licen[sc]e|psf licen[sc]e)", ("python", "psf"), ("2.0",)),
    ("odbl", "(?:open database licen[sc]e|odbl)", ("open database", "odbl"), ("1.0",)),
    ("ofl", "(?:open font licen[sc]e|ofl)", ("open font", "ofl"), ("1.0", "1.1")),
    ("qpl", "q public licen[sc]e", ("q public",), ("1.0",)),
    ("cecill", "cecill(?: [abc])?(?: licen[sc]e)?", ("cecill",), ("1.0", "2.0", "2.1")),
    ("ecl", "educational community licen[sc]e", ("educational community",), ("1.0", "2.0")),
    ("lppl", "(?:latex project public licen[sc]e|lppl)", ("latex project", "lppl"), ("1.0", "1.2", "1.3")),
    ("ms", "microsoft (?:public|reciprocal) licen[sc]e", ("microsoft",), ()),
    ("wtfpl", "(?:do what the fuck you want to public licen[sc]e|wtfpl)", ("do what the", "wtfpl"), ("1.0", "2.0")),
    ("unlicense", "(?:the unlicense|unlicense org)", ("unlicense",), ()),
    ("isc", "isc licen[sc]e", ("isc",), ()),
    ("zlib", "zlib(?: libpng)? licen[sc]e", ("zlib",), ()),
    ("mit", "(?:mit|expat|x11) licen[sc]e", ("mit", "expat", "x11"), ()),
    ("bsd", "(?:bsd|berkeley software distribution)(?: style)? licen[sc]e", ("bsd", "berkeley"), ()),
)
#: Creative Commons elements and versions.
CC_TERMS = {
    "cc-by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    "cc-by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "cc-by-nd": ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    "cc-by-nc": ("by nc", "attribution non ?commercial"),
    "cc-by-sa": ("by sa", "attribution share ?alike"),
    "cc-by": ("by", "attribution"),
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
def rules() -> list[Rule]:
    """All rules, most specific first."""
    out = [Rule(label, phrase(words), (words.split()[-1] if label != "cc-by" else "cc",), 0, True) for words, label in BASE.items()]
    loose = lambda p: p.replace(" ?", GAP[:-1] + "*").replace(" ", GAP)
    edge = lambda p: rf"(?<!{WORD})(?:{p})(?!{WORD})"
    verb = f"(?:{GAP}version|{GAP}v|v(?=[0-9]))?"
    for label, name, keys, versions in FAMILIES:
        for v in versions:
            major, minor = v.split(".")
            number = f"{major}{GAP}{minor}" if minor.strip("0") or major == "0" else f"{major}(?:{GAP}0)?"
            ver = f"{verb}(?:{GAP})?{number}"
            out.append(Rule(f"{label}-{v}-or-later", edge(loose(name) + ver + loose("(?: or (?:at your option )?(?:any )?later(?: version)?)")), keys, 90))
            out.append(Rule(f"{label}-{v}-or-later", edge(loose(name) + ver) + r"\+", keys, 90))
            out.append(Rule(f"{label}-{v}-only", edge(loose(name) + ver + GAP + "only"), keys, 90))
            out.append(Rule(f"{label}-{v}", edge(f"version{GAP}{number}" + loose(" of the (?:gnu )?") + loose(name)), keys, 85))
            out.append(Rule(f"{label}-{v}", edge(loose("licensed under (?:the )?(?:gnu )?") + loose(name) + ver), keys, 80))
            out.append(Rule(f"{label}-{v}", edge(loose(name) + ver), keys, 70))
        out.append(Rule(label, edge(loose("(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?") + loose(name)), keys, 50))
        out.append(Rule(label, edge(loose(name)), keys, 30))
    for label, (short, long) in CC_TERMS.items():
        for v in CC_VERSIONS:
            number = GAP.join(v.split("."))
            out.append(Rule(f"{label}-{v}", edge("cc" + GAP + loose(short) + GAP + number), ("cc",), 88))
            out.append(Rule(f"{label}-{v}", edge(loose("creative commons " + long) + f"(?:{GAP}international|{GAP}licen[sc]e)*{GAP}{number}"), ("creative commons",), 88))
            out.append(Rule(f"{label}-{v}", edge(loose("creativecommons org licenses ") + GAP.join(short.split()) + GAP + number), ("creativecommons",), 88))
        out.append(Rule(label, edge("cc" + GAP + loose(short)), ("cc",), 60))
        out.append(Rule(label, edge(loose("creative commons " + long)), ("creative commons",), 60))
    for line in SIGNATURES.strip().splitlines():
        label, priority, keys, words = (part.strip() for part in line.split(" | "))
        out.append(Rule(label, edge(loose(words)), tuple(keys.split("/")), int(priority)))
    for name in SPDX.lower().split():
        before = r":?(?:[( ]*[a-z0-9.+-]+[) ]+(?:or|and|with) +)*[( ]*"  # other names of the same expression
        out.append(Rule(name, rf"(?<!{WORD})spdx{GAP}licen[sc]e{GAP}identifier{before}(?P<at>{re.escape(name)})(?![a-z0-9.+-]*[a-z0-9+])", ("spdx",), 96))
    return sorted(out, key=lambda r: (r.base, -r.priority))


class Scanner:
    def __init__(self, own: list[Rule] | None = None):
        import ahocorasick

        self.rules = own or rules()
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        by_key: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                by_key.setdefault(max(k.split(), key=len), []).append(i)  # of several words the longest, since what separates them varies
        self.automaton = ahocorasick.Automaton()
        for k, which in by_key.items():
            self.automaton.add_word(k, (len(k), tuple(which)))
        self.automaton.make_automaton()

    def due(self, low: str) -> list[int]:
        """The rules that have a keyword in the text as a whole word, or with "v" and a digit right after it."""
        found = set()
        for end, (n, which) in self.automaton.iter(low):
            tail = low[end + 1 : end + 3]
            versioned = len(tail) == 2 and tail[0] == "v" and "0" <= tail[1] <= "9"
            if (versioned or not (tail and _word(tail[0]))) and not (end >= n and _word(low[end - n])):
                found.update(which)
        return sorted(found)

    def detections(self, low: str) -> tuple[list[tuple[int, int, Rule]], list[tuple[int, int, Rule]]]:
        """Base places, and the method's detections after suppression, of a lower-cased text; as start, end, rule."""
        base, found = [], []
        for i in self.due(low):
            rule = self.rules[i]
            part = "at" if "at" in self.compiled[i].groupindex else 0  # a rule may mark what of its match it detects
            (base if rule.base else found).extend((*m.span(part), rule) for m in self.compiled[i].finditer(low))
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        taken: list[tuple[int, int, Rule]] = []
        spans: list[tuple[int, int]] = []  # disjoint or merely overlapping intervals, in order of start
        for a, b, rule in found:
            if not _inside(spans, a, b):
                taken.append((a, b, rule))
        return sorted(base, key=lambda x: x[:2]), sorted(taken, key=lambda x: x[:2])


def _inside(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) lies inside a taken interval; if not, take it.

    Starts and ends of the kept intervals both rise (an interval that another contains is never needed), so only the
    last one that begins at or before ``a`` can contain it.
    """
    from bisect import bisect_right

    i = bisect_right(spans, (a, 1 << 62))
    if i and spans[i - 1][1] >= b:
        return True
    j = i
    while j < len(spans) and spans[j][1] <= b:
        j += 1
    if i and spans[i - 1][0] == a:
        i -= 1
    spans[i:j] = [(a, b)]
    return False


def _word(c: str) -> bool:
    return c > "\x7f" or "a" <= c <= "z" or "0" <= c <= "9"


def lower_ascii(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = True
_IS_WORD[128:] = True


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", own: list[Rule] | None = None) -> DataFrame:
    """One row per document: word and base counts, first and last base word, labels, score and the detections' spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own)
        word_start = re.compile(rf"(?<!{WORD}){WORD}")
        for batch in runs(batches):
            data, starts, ends = flat(batch.column("text"))
            word = _IS_WORD[data]
            first = word.copy()
            first[1:] &= ~word[:-1]
            inner = starts[(starts < len(data)) & (ends > starts)]
            first[inner] = word[inner]
            count = np.concatenate([[0], np.cumsum(first)])
            n_words = count[ends] - count[starts]
            rows = []
            for text, n in zip(batch.column("text").to_pylist(), n_words.tolist(), strict=True):
                low = lower_ascii(text or "")
                base, taken = scanner.detections(low)
                places = []
                for x in (base[:1] + base[-1:]) if base else []:
                    places.append(sum(1 for _ in word_start.finditer(low, 0, x[0] + 1)) - 1)
                labels = sorted({r.label for _, _, r in base + taken})
                best = max([r.priority for _, _, r in taken] + [40 * bool(base)], default=0)
                rows.append((n, len(base), places[0] if base else None, places[1] if base else None, ",".join(sorted({r.label for _, _, r in base})), ",".join(labels), min(1.0, best / 100 + (0.1 if base and taken else 0.0)), [f"{a}:{b}:{r.label}" for a, b, r in taken]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return two(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>")
