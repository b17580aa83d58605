"""License scan: ordered signature rules over a text's words, in DataFrame operations only."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: What stands between words; a word is letters and digits, or characters beyond ASCII.
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class Rule(NamedTuple):
    label: str
    #: 1: a statement that a license applies; 2: a license's full name or address; 3: words that hint at one.
    level: int
    #: A regular expression over words, single blanks between.
    pattern: str
    #: Every match has a word that starts with one of these; other texts are never tried.
    anchors: tuple[str, ...]
    #: What every match holds (with the blank in front, where it starts a word); checked before the pattern is.
    keyword: str
    #: Whether every match starts with a verb and ``under``, ``by`` or ``as``.
    stated: bool = False


# label | name as a pattern | other spellings, each a rule of its own
NAMES = r"""
mit | mit | expat, mit x11, mit expat
apache | apache( software)? license | asl 2 0, apache 2 0, apache software foundation license, apache license version 2 0, apache license version 1 1
gpl | (gnu )?general public license | gnu gpl, gpl ?v?2( 0)?( or later| only)?, gpl ?v?3( 0)?( or later| only)?, gnu general public license version [23]
lgpl | (gnu )?lesser general public license | lgpl, gnu lgpl, lgpl ?v?2 1, lgpl ?v?3, library general public license
agpl | (gnu )?affero general public license | agpl, agpl ?v?3, gnu agpl
fdl | (gnu )?free documentation license | gfdl, gnu fdl, fdl 1 [123]
bsd-2-clause | (bsd 2 clause|simplified bsd)( license)? | freebsd license, two clause bsd
bsd-3-clause | (bsd 3 clause|new bsd|modified bsd)( license)? | three clause bsd, revised bsd
bsd-4-clause | (bsd 4 clause|original bsd)( license)? | four clause bsd, bsd old
bsd-0 | 0bsd | zero clause bsd, bsd zero clause
bsd | bsd license | bsd style license, berkeley software distribution license
isc | isc license | internet systems consortium license, isc style license
mpl-2.0 | mozilla public license( version)? 2 0 | mpl 2 0, mpl v2
mpl-1.1 | mozilla public license( version)? 1 1 | mpl 1 1
mpl | mozilla public license | mozilla license
epl | eclipse public license( v| version)?( [12] 0)? | epl 1 0, epl 2 0
edl | eclipse distribution license | edl 1 0
cpl | common public license( version)?( 1 0)? | cpl 1 0
cddl | common development and distribution license | cddl, cddl 1 [01]
ms-pl | microsoft public license | ms pl
ms-rl | microsoft reciprocal license | ms rl
artistic | (perl )?artistic license( 2 0| 1 0)? | artistic 2 0, clarified artistic license
zlib | zlib license | zlib libpng license, zlib png license
libpng | libpng license | png reference library license
boost | boost software license( version)?( 1 0)? | bsl 1 0, boost license
unlicense | (the )?unlicense | unlicensed into the public domain, unlicense org
wtfpl | wtfpl | do what the fuck you want to public license
cc0 | cc0( 1 0)?( universal)? | creative commons zero, cc zero
cc-by-nc-nd | cc by nc nd( \d 0)? | attribution non commercial no derivatives
cc-by-nc-nd | attribution noncommercial noderiv\w*( \d 0)? |
cc-by-nc-sa | cc by nc sa( \d 0)? | attribution non commercial share alike
cc-by-nc-sa | attribution noncommercial sharealike( \d 0)? |
cc-by-nc | cc by nc( \d 0)? | attribution non commercial
cc-by-nc | attribution noncommercial( \d 0)? |
cc-by-nd | cc by nd( \d 0)? | attribution no derivatives
cc-by-nd | attribution noderiv\w*( \d 0)? |
cc-by-sa | cc by sa( \d 0)? | attribution share alike
cc-by-sa | attribution sharealike( \d 0)? |
cc-by | cc by( \d 0)? | creative commons attribution, creative commons by
cc | creative commons( license)? | cc licensed, some rights reserved
public-domain | (in|into|to) the public domain | public domain dedication, released to the public domain, public domain mark
pddl | (open data commons )?public domain dedication and license | pddl
odbl | (open data commons )?open database license | odbl
odc-by | open data commons attribution license | odc by
python | python software foundation license | psf license, psfl, python license
ruby | ruby license | ruby s license
php | php license( version)?( 3 0\d?)? | php 3 01
openssl | openssl license | ssleay license, openssl ssleay
postgresql | postgresql license | postgres license
tcl | tcl tk license | tcl license
w3c | w3c( software)?( notice and)? license | w3c document license
ofl | (sil )?open font license( version)?( 1 1)? | sil ofl, ofl 1 1
ncsa | (university of illinois )?ncsa( open source)? license | university of illinois open source license
afl | academic free license( version)?( \d \d)? | afl 3 0
osl | open software license( version)?( \d \d)? | osl 3 0
eupl | european union public licen[cs]e | eupl, eupl 1 2
cecill | cecill( license)? | cecill b, cecill c
ipl | ibm public license | ibm open source license
qpl | q public license | qpl 1 0
npl | netscape public license | npl 1 1
apsl | apple public source license | apsl 2 0
sleepycat | sleepycat license | sleepycat public license
vim | vim license | vim charityware license
x11 | x11 license | x11 style license, x consortium license
hpnd | historical permission notice and disclaimer | hpnd
beerware | beerware( license)? | beer ware license
json | json license | good not evil license
upl | universal permissive license | upl 1 0
elastic | elastic license( 2 0| version 2)? | elv2
sspl | server side public license | sspl, sspl v1
busl | business source license | busl 1 1, bsl 1 1
commons-clause | commons clause | commons clause license condition
polyform | polyform [a-z]+( [a-z]+)? license | polyform noncommercial, polyform small business
blueoak | blue oak model license | blueoak 1 0 0
mulan | mulan (permissive|psl)( software license)? | mulan psl v2
openrail | (creativeml |bigscience )?open ?rail( m)?( license)? | responsible ai license
llama | llama \d community license | llama community license agreement
"""

# Sentences of the licenses' own texts: label | pattern
PASSAGES = """
mit | permission is hereby granted free of charge to any person obtaining a copy
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | all advertising materials mentioning features or use of this software must display
apache | you may obtain a copy of the license at (http |https )?www apache org licenses license 2 0
apache | distributed under the license is distributed on an as is basis
gpl | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
agpl | you can redistribute it and or modify it under the terms of the gnu affero general public license
mpl-2.0 | if a copy of the mpl was not distributed with this file
boost | boost software license version 1 0 august 17th 2003
zlib | altered source versions must be plainly marked as such
unlicense | this is free and unencumbered software released into the public domain
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies .{1,80} you just do what the fuck you want to
cc | creativecommons org licen[cs]es
cc0 | creativecommons org publicdomain zero
gpl | (www )?gnu org licenses( gpl)?
mit | opensource org licenses mit
bsd | opensource org licenses bsd
proprietary | all rights reserved
proprietary | proprietary and confidential
other | licensed under
other | see (the )?(file )?license( txt| md)? for details
"""

VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "covered")
LINKS = ("under", "by", "as")
#: Words that many texts have: one is an anchor only where a phrase has no other.
COMMON = frozenset(
    "license licence licensed public software open version source general new original free use mit license s for the and of in to or as is on an any all not no do what you can may must "
    "this that with without from be are it copy copies style data system common public domain notice terms names name two three four zero under distributed modified simplified style "
    "licen clause identifier good mark file university business august document database library community reference condition server".split()
)


def _lines(table: str) -> list[list[str]]:
    return [[x.strip() for x in re.split(r" \|(?: |$)", line)] for line in table.strip().splitlines()]


def _runs(pattern: str) -> list[str]:
    """The plain runs of characters that every match of a pattern holds; one starts with a blank where it starts a word."""
    groups = lambda m: "\0 " if all(x.endswith(" ") for x in m[1].split("|")) else "\0"
    before = None
    while before != pattern:
        before, pattern = pattern, re.sub(r"\(([^()]*)\)\??", groups, pattern)
    pattern = re.sub(r"(?:\[[^\]]*\]|\\.|[^\0])(?:[?*+]|\{[^}]*\})|\[[^\]]*\]|\\.", "\0", pattern)
    return re.sub("\0+", "\0", f" {pattern}").split("\0")


def keyword(pattern: str) -> str:
    return max(_runs(pattern), key=len)


def anchors(pattern: str) -> tuple[str, ...]:
    """Beginnings of words of which every match of a pattern has one."""
    words = [w for run in _runs(pattern) for w in run.split(" ")[1:] if w]
    if words:
        return (max(words, key=lambda w: (w not in COMMON, len(w))),)
    choice = re.search(r"\(([^()]*)\)(?!\?)", pattern)
    if not choice:
        raise ValueError(f"nothing is in every match of {pattern!r}")
    return tuple(dict.fromkeys(a for x in choice[1].split("|") for a in anchors(x)))


def _rule(label: str, level: int, pattern: str) -> Rule:
    return Rule(label, level, pattern, anchors(pattern), keyword(pattern))


def rules() -> list[Rule]:
    """All rules in order of priority: statements, then names and addresses, then hints.

    No pattern repeats a group of alternatives: the JVM's engine would recurse for each repetition.
    """
    out = [_rule(label, 2, phrase) for phrase, label in BASE]
    for label, name, others in _lines(NAMES):
        words = label.replace("-", " ").replace(".", " ")
        spellings = [name, *filter(None, others.split(", "))]
        out.append(_rule(label, 1, f"spdx license identifier {words}(?: \\d)*( or later| only)?"))
        either = "|".join(dict.fromkeys([*sorted(spellings, key=len, reverse=True), words]))
        under = f"({'|'.join(VERBS)}) ({'|'.join(LINKS)}) (the )?(terms of )?(the )?(gnu )?({either})( license| licence)?( version \\d+( \\d+)?| \\d 0)?"
        out.append(Rule(label, 1, under, tuple(dict.fromkeys(a for x in [*spellings, words] for a in anchors(x))), "", True))
        # A single word is a name only with the word license behind it.
        own = name if "license" in name or "licence" in name else f"{name}( license)?"
        out.append(_rule(label, 2, f"(the )?{own}" if " " in name or "license" in name else f"(the )?{name} licen[cs]e"))
        for other in spellings[1:]:
            out.append(_rule(label, 2 if " " in other else 3, other))
    out += [_rule(label, 3 if label in ("other", "proprietary") else 1, pattern) for label, pattern in _lines(PASSAGES)]
    return sorted(dict.fromkeys(out), key=lambda r: r.level)


def trie(words: list[str]) -> str:
    """An expression for the words, none of which begins another, that shares their beginnings."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + (rest[0] if len(rest) == 1 else trie(rest)) for c, rest in sorted(by_first.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


class Gate(NamedTuple):
    #: Finds the anchors of a text, and where a statement begins.
    pattern: str
    #: Numbers of the rules that each find of it brings up.
    tried: dict[str, list[int]]


def gate(listed: list[Rule]) -> Gate:
    found = sorted({a for r in listed for a in r.anchors})
    heads = [a for a in found if not any(a != b and a.startswith(b) for b in found)]
    by_head = {h: [i for i, r in enumerate(listed) if any(a.startswith(h) for a in r.anchors)] for h in heads}
    stated = [f"{v} {x}" for v in VERBS for x in LINKS]
    tried = {s: sorted({i for w in s.split(" ") for h in heads if w.startswith(h) for i in by_head[h]}) for s in stated}
    return Gate(f" ((?:{'|'.join(VERBS)}) (?:{'|'.join(LINKS)})(?= )|{trie(heads)})", {**tried, **by_head})


#: What a detection of each level adds to the score: the chance, by judgement, that a license is meant.
TRUST = {1: 0.95, 2: 0.8, 3: 0.4}
#: Matches whose places are added up in one list.
PART = 512
SPANS = "array<struct<start:int,stop:int,level:int,label:string>>"


def _blanks(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def _labels_of(detections: str, level: int) -> Column:
    """How many labels the detections of a level have."""
    return F.size(F.array_distinct(F.transform(F.filter(detections, lambda d: d["level"] == level), lambda d: d["label"])))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(items: Column, zero: Column, plus: Callable[[Column, Column], Column], kind: str) -> Column:
    """What is added up before each of the items: in parts of ``PART``, so that no list is copied for each item."""

    def before(of: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(of, start, step, lambda acc: acc["out"])

    last = F.greatest(F.lit(0), F.ceil(F.size(items) / PART).cast("int") - 1)
    cut = _bound(items, lambda xs: F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(xs, c * PART + 1, PART)))
    return _bound(cut, lambda parts: F.flatten(F.zip_with(parts, before(F.transform(parts, lambda p: F.aggregate(p, zero, plus)), zero), before)))


def _spans(norm: Column, rule: Column) -> Column:
    """Word spans of a rule's matches, from the left, none overlapping another: mark them, and count the words between the marks."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?s) (?:"), rule["pattern"], F.lit(r")(?= |\z)")), F.lit("\1$0\2"))

    def span(piece: Column, at: Column) -> Column:
        stop = at + _blanks(F.substring_index(piece, "\2", 1))
        # The first piece stands before the first match.
        return F.when(F.contains(piece, F.lit("\2")), F.struct(at.alias("start"), stop.alias("stop"), rule["level"].alias("level"), rule["label"].alias("label")))

    def of(pieces: Column) -> Column:
        counts = F.transform(pieces, _blanks)
        return F.array_compact(F.zip_with(pieces, _running(counts, F.lit(0), lambda x, y: (x + y).cast("int"), "int"), span))

    return _bound(F.split(marked, "\1", -1), of)


def _survivors(spans: Column) -> Column:
    """Spans that lie in no other span of equal or higher priority: by start, longest first, none may end before one of those before it."""
    levels = (1, 2, 3)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("stop"), s["level"].alias("level"), s["label"].alias("label"))))
    kind = f"struct<{','.join(f'e{k}:int' for k in levels)}>"
    none = F.struct(*[F.lit(-1).alias(f"e{k}") for k in levels])
    #: How far spans of each level or a higher one reach.
    own = lambda s: F.struct(*[F.when(s["level"] <= k, -s["stop"]).otherwise(-1).cast("int").alias(f"e{k}") for k in levels])
    most = lambda a, b: F.struct(*[F.greatest(a[f"e{k}"], b[f"e{k}"]).cast("int").alias(f"e{k}") for k in levels])

    def kept(s: Column, reach: Column) -> Column:
        before = F.when(s["level"] == 1, reach["e1"]).when(s["level"] == 2, reach["e2"]).otherwise(reach["e3"])
        return F.when(before < -s["stop"], F.struct(s["start"].alias("start"), (-s["stop"]).alias("stop"), s["level"].alias("level"), s["label"].alias("label")))

    left = _bound(ordered, lambda x: F.array_compact(F.zip_with(x, _running(F.transform(x, own), none, most, kind), kept)))
    return F.coalesce(left, F.array().cast(SPANS))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    One expression over the whole text finds the anchors in it; only rules of
    these are tried, and of those only the ones whose keyword it holds.  Anchors
    and keywords are derived from the patterns, so that every match has them.  A
    detection (words ``start`` to ``stop``, exclusive) that lies inside another
    of equal or higher priority is suppressed.  All is row-local: no shuffle.

    ``n_base``, ``first_word`` and ``last_word`` tell of the base phrases, which
    nothing suppresses; their labels are always among ``labels``.  The score is
    1 less the product of the chances that each detected label is none.  Null
    text counts as empty: no words, no labels, score 0, null places.  A very
    long text is scanned whole, in the memory of its own row and in time that
    grows as its length, however many matches it has.  Repeated rows and
    ids are answered each; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    listed = rules()
    way = gate(listed)
    all_rules = F.from_json(F.lit(json.dumps([r._asdict() for r in listed])), "array<struct<label:string,level:int,pattern:string,keyword:string,stated:boolean>>")
    tried = F.from_json(F.lit(json.dumps(way.tried)), "map<string,array<int>>")
    # Lower case makes no new word and no new ASCII letter but of the Kelvin sign.
    lower = F.lower(F.replace(text_or_empty(), F.lit("\u212a"), F.lit("\u03ba")))
    words = F.trim(F.regexp_replace(lower, OTHER, " "))
    # The stop in front makes room for a match at the first word.
    rows = docs.select("doc_id", F.concat(F.lit(". "), words).alias("norm"))
    norm = F.col("norm")
    any_base = F.lit(False)
    for p, _ in BASE:
        any_base = any_base | F.contains(norm, F.lit(f" {p}"))
    base = r"(?= (?:" + "|".join(p for p, _ in BASE) + r")(?: |\z))"
    rows = rows.select(
        "doc_id",
        "norm",
        F.when(norm == ". ", 0).otherwise(_blanks(norm)).cast("long").alias("n_words"),
        F.when(any_base, F.split(norm, base, -1)).otherwise(F.array(norm)).alias("pieces"),
        F.array_distinct(F.regexp_extract_all(norm, F.lit(way.pattern), F.lit(1))).alias("hits"),
    )
    numbers = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.element_at(tried, h))))
    stated = F.exists("hits", lambda h: F.contains(h, F.lit(" ")))
    chosen = F.filter(F.transform(numbers, lambda i: F.get(all_rules, i)), lambda r: (~r["stated"] | stated) & F.contains(norm, r["keyword"]))
    rows = rows.withColumn("detections", _survivors(F.flatten(F.transform(chosen, lambda r: _spans(norm, r)))))
    n_base = F.size("pieces") - 1
    found = n_base > 0
    base_labels = F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(f" {p}")) & norm.rlike(rf" {p}(?: |\z)"), F.lit(label)) for p, label in BASE]))
    rows = rows.withColumn("base", F.coalesce(base_labels, F.array().cast("array<string>")))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    doubt = F.lit(1.0)
    for level, trust in TRUST.items():
        doubt = doubt * F.pow(F.lit(1 - trust), _labels_of("detections", level))
    return rows.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.when(found, _blanks(F.get("pieces", F.lit(0)))).cast("long").alias("first_word"),
        F.when(found, F.col("n_words") - _blanks(F.element_at("pieces", -1))).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
        "detections",
    )
