"""The license scan against a matcher in plain Python that tries every rule on every text."""

import random
import re
from collections import Counter

from conftest import DATA
from odd_rows import odd  # noqa: F401

from stepwise.llm import license_scan
from stepwise.llm.license_scan import scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def find_phrase(words, phrase):
    p = phrase.split(" ")
    return [i for i in range(len(words)) if words[i : i + len(p)] == p]


def plain_detections(text):
    """(start, stop, level, label) of all rules, none of them gated, less those inside others."""
    norm = "".join(f" {w}" for w in words_of(text))
    found = set()
    for r in license_scan.rules():
        for m in re.finditer(rf" (?:{r.pattern})(?= |\Z)", norm, re.ASCII | re.DOTALL):
            start = norm[: m.start()].count(" ")
            found.add((start, start + m[0].count(" "), r.level, r.label))
    inside = lambda s, t: s != t and t[2] <= s[2] and t[0] <= s[0] and s[1] <= t[1] and (s[:2] != t[:2] or t[2:] < s[2:])
    return sorted(s for s in found if not any(inside(s, t) for t in found))


def same_as_plain(df):
    given = Counter(r["text"] for r in df.select("text").collect())
    want = {t: [tuple(d) for d in plain_detections(t)] for t in given}
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    n = 0
    for r in scan(df).collect():
        found = sorted((d["start"], d["stop"], d["level"], d["label"]) for d in r["detections"])
        assert found == want[texts[r["doc_id"]]], (texts[r["doc_id"]], found)
        assert set(filter(None, r["labels"].split(","))) == {d[3] for d in found} | set(filter(None, r["base_labels"].split(",")))
        n += len(found)
    return n


def test_base_phrases(spark, odd):
    for df in (spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), odd):
        given = Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
        want = []
        for (doc_id, text), n in given.items():
            words = words_of(text)
            at = {label: find_phrase(words, p) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))}
            places = sorted(sum(at.values(), []))
            row = (doc_id, len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(k for k, v in at.items() if v)))
            want += [row] * n
        rows = scan(df).collect()
        got = [tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows]
        assert Counter(got) == Counter(want)
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_detections_equal_a_plain_matcher(spark):
    assert same_as_plain(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")) > 0


def phrases(parsed):
    """Texts that a rule's pattern matches: each alternative, with and without what is optional."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(arg)]
        elif kind == "ANY":
            more = ["x"]
        elif kind == "IN":
            first = arg[0]
            more = ["1" if str(first[0]) == "CATEGORY" else chr(first[1] if str(first[0]) == "LITERAL" else first[1][0])]
        elif kind == "SUBPATTERN":
            more = phrases(arg[3])
        elif kind == "BRANCH":
            more = [p for branch in arg[1] for p in phrases(branch)]
        else:
            assert kind == "MAX_REPEAT", kind
            more = ([""] if arg[0] == 0 else []) + phrases(arg[2])
        out = list(dict.fromkeys(a + b for a in out for b in more))
    return out


def own_phrases(rule):
    if rule.stated:
        # One verb and all spellings; then all verbs.
        verbs, links, *_ = re.findall(r"\(([^()]*)\) ", rule.pattern)
        tail = re.sub(r"^\([^()]*\) \([^()]*\) \(the \)\?\(terms of \)\?\(the \)\?", "", rule.pattern)
        names = phrases(re._parser.parse(tail))
        return [f"released under {n}" for n in names] + [f"{v} {x} the terms of the {names[0]}" for v in verbs.split("|") for x in links.split("|")]
    return phrases(re._parser.parse(rule.pattern))


def test_every_rule_passes_its_gate_and_finds_its_own_phrases(spark):
    listed = license_scan.rules()
    gate = license_scan.gate(listed)
    assert len(listed) > 300
    texts = set()
    for i, rule in enumerate(listed):
        for p in own_phrases(rule):
            norm = f" {p}"
            assert re.fullmatch(rule.pattern, p, re.ASCII), (rule, p)
            assert rule.keyword in norm and any(i in gate.tried[h] for h in re.findall(gate.pattern, norm)), (rule, p)
            assert not rule.stated or any(" " in h for h in re.findall(gate.pattern, norm)), (rule, p)
        texts.update(random.Random(i).sample(own_phrases(rule), min(4, len(own_phrases(rule)))))
    df = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string").repartition(8)
    assert same_as_plain(df) >= len(texts)


def test_labels_and_true_spans(spark):
    texts = {
        "See the GNU Lesser General Public License": {(1, 7, "lgpl")},
        "All rights reserved. Proprietary and confidential.": {(0, 3, "proprietary"), (3, 6, "proprietary")},
        "CDDL": {(0, 1, "cddl")},
        "CC BY-SA 4.0": {(0, 5, "cc-by-sa")},
        "available under MIT": {(0, 3, "mit")},
        "released under the gpl": {(0, 4, "gpl")},
        "Licensed under MIT, licensed under MIT.": {(0, 3, "mit"), (3, 6, "mit")},
        "kein Wort mit Lizenz": set(),
        "MIT LICENSE\u2028": set(),
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {(d["start"], d["stop"], d["label"]) for d in r["detections"]} for r in scan(df).collect()}
    assert got == dict(enumerate(texts.values()))
    assert same_as_plain(df) > 0
    row = scan(spark.createDataFrame([(1, "Licensed under the GNU Lesser General Public License. Also BSD 3-Clause License, and CC0.")], "doc_id long, text string")).first()
    assert {"lgpl", "bsd-3-clause", "gpl"} <= set(row["labels"].split(","))


def optional_parts(pattern):
    """The bodies of what a pattern may repeat without bound."""
    return [m[1] or m[0][:-1] for m in re.finditer(r"\((?:\?:)?([^()]*)\)[*+]|(?:\[[^\]]*\]|\\.|.)[*+]", pattern)]


def test_no_rule_repeats_alternatives():
    for rule in license_scan.rules():
        assert not re.search(r"\|[^()]*\)[*+]|\)\)[*+]", rule.pattern), rule
        assert not re.search(r"\((?!\?:)[^()]*\)[*+]", rule.pattern), rule


def test_repetitions_of_any_length(spark):
    """What a rule may repeat, 100,000 times over: no recursion in the JVM's engine, and the plain matcher's spans."""
    repeated = [r for r in license_scan.rules() if optional_parts(r.pattern) and not r.stated]
    texts = []
    for rule in repeated[:3] + [r for r in repeated if "w" in "".join(optional_parts(r.pattern))][:2]:
        own = min(phrases(re._parser.parse(rule.pattern)), key=len)
        texts.append(own + (" 0" if "\\d)*" in rule.pattern else "x") * 100_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan(df).collect()}
    for i, text in enumerate(texts):
        assert got[i]["n_words"] == text.count(" ") + 1 and got[i]["detections"], text[:60]
        assert max(d["stop"] for d in got[i]["detections"]) == got[i]["n_words"]


def test_many_matches_take_linear_time(spark):
    import time

    took = []
    for n in (3_000, 60_000):
        df = spark.createDataFrame([(1, "MIT License, " * n)], "doc_id long, text string")
        began = time.perf_counter()
        row = scan(df).first()
        took.append(time.perf_counter() - began)
        assert len(row["detections"]) == row["n_base"] == n and row["detections"][-1]["stop"] == row["n_words"] == 2 * n
    # Twenty times the text; the square of it would be four hundred.
    assert took[1] < 60 * max(took[0], 0.5)


def test_detections_of_many_parts_equal_a_plain_matcher(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "PART", 3)
    names = ["MIT License", "Apache License 2.0", "GNU Lesser General Public License", "BSD 3-Clause", "all rights reserved", "released under the MIT", "word", "gpl v3"]
    rng = random.Random(11)
    rows = [(i, ", ".join(rng.choice(names) for _ in range(rng.randrange(40)))) for i in range(30)]
    assert same_as_plain(spark.createDataFrame(rows, "doc_id long, text string")) > 100
