"""Repeated passages, vector codes and phrases: against brute force, on odd and on empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from odd_rows import odd  # noqa: F401
from pyspark.sql import functions as F

from stepwise.llm import phrases, suffix_dedup, vector_codes
from stepwise.llm.queries import QUERIES
from stepwise.llm.suffix_array import common_prefixes, suffix_array


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, 2 + seed % 5, 1 + seed * 3)
    t = np.append(np.tile(t, 1 + seed % 4), 0).astype(np.uint16)
    rows = t.tolist()
    want = sorted(range(len(rows)), key=lambda i: rows[i:])
    order = suffix_array(t, int(t.max()) + 1)
    assert order.tolist() == want

    def shared(i, j):
        n = 0
        while rows[i + n] == rows[j + n]:
            n += 1
        return n

    assert common_prefixes(t, order).tolist() == [0] + [shared(a, b) for a, b in zip(want, want[1:], strict=False)]


def plain_repeats(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        edges = np.diff(gone.astype(int), prepend=0, append=0)
        spans = tuple(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        out[(i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


def found_repeats(docs, **more):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], tuple(map(tuple, r["spans"])), r["kept_sha256"]) for r in suffix_dedup.repeats(docs, **more).collect())


def test_repeats_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = plain_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 400)
    assert found_repeats(docs) == want
    got = QUERIES["op11_suffix_dedup"](spark, f"{DATA}/sf0.001").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, n, k, len(s), h) for (i, n, k, s, h) in want.elements())


def hot_rows():
    """One passage in hundreds of texts that go on differently, a text that repeats itself, runs of one letter, and copies."""
    rng = random.Random(4)
    text = lambda n, letters="abcdef ": "".join(rng.choices(letters, k=n))
    passage = text(150)
    rows = [(i, text(rng.randrange(90), "ab") + passage + text(rng.randrange(90), "ab")) for i in range(400)]
    rows += [(1000, "ab" * 300), (1001, "x" * 1500), (1002, text(7) * 90), (1003, "ü€" + text(200) + "ü€"), (1004, text(300))]
    rows += [(1005, rows[-1][1]), (1005, rows[-1][1]), (None, rows[-1][1] + "!"), (1006, None), (1007, ""), (1008, "x" * 63), (1009, "y" * 64)]
    return rows


def test_repeats_of_hot_passages(spark, monkeypatch):
    rows = hot_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_repeats(rows, 64)
    assert found_repeats(docs, window=64) == want
    # Groups that are split up to three times, small shards, and texts that are hashed in parts.
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    seen = []
    whole = suffix_dedup._found
    monkeypatch.setattr(suffix_dedup, "_found", lambda *a: seen.append(1) or whole(*a))
    assert found_repeats(docs, window=64) == want and seen


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 500)
    import pyarrow as pa

    text = random.Random(2).randbytes(3000)
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([text], pa.binary()), pa.array([1])], ["key", "text", "copies"])
    rows = [r for out in suffix_dedup._segments(64)(iter([batch])) for r in out.to_pylist()]
    at = [k for r in rows for k in range(r["start"], r["start"] + r["n"])]
    assert at == list(range(3000 - 63))


def test_repeats_on_odd_and_empty_tables(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 1000]
    assert found_repeats(odd.where("text is null or length(text) < 1000")) == plain_repeats(short, 400)
    got = sorted(suffix_dedup.repeats(odd).collect(), key=lambda r: r["n_bytes"])
    # The two long texts repeat themselves and one another but for the last byte.
    assert len(got) == len(rows) and [r["n_bytes"] - r["n_removed"] for r in got[-2:]] == [0, 1]
    assert suffix_dedup.repeats(odd.where("false")).collect() == []
    left = suffix_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == len(rows)
    assert suffix_dedup.without_repeats(odd.where("false")).count() == 0


def test_texts_without_repeats(spark):
    rows = [(i, t, i, "k") for i, t in hot_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, left int, `key` string")
    spans = {(r[0], r[4]): r[3] for r in plain_repeats([r[:2] for r in rows], 64).elements()}
    got = suffix_dedup.without_repeats(docs, window=64).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all((r["text"] is None) == (r["doc_id"] == 1006) for r in got)
    kept = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got if r["doc_id"] != 1003}
    assert kept == {k for k in spans if k[0] != 1003}


def plain_codes(rows, parts, entries, rounds):
    """Codes by all distances, in Python's whole numbers."""
    kept = [(i, label, [int(np.floor(1024 * x)) for x in v]) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2])
    at = [d * i // parts for i in range(parts + 1)]
    cut = [[r[2][a:b] for a, b in zip(at, at[1:], strict=False)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, b in zip(cut, best, strict=True) if b[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = assign()
    error = [sum(d for d, _ in b) for b in best]
    total = Counter()
    for (_, label, _), e in zip(kept, error, strict=True):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, tuple(k for _, k in b), e, total[label], digest) for (i, label, _), b, e in zip(kept, best, error, strict=True))


def found_codes(spark, rows, **more):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3).withColumn("w", F.lit("x")).withColumn("codes", F.lit(1))
    return Counter((r["vec_id"], tuple(r["codes"]), r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compressed(vectors, **more).collect())


def test_codes_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice(["a", "b", None])) for i in range(150)]
    rows += rows[:9] + [(7, [0.5] * 8, "a"), (None, [0.25] * 8, None), (200, None, "a"), (201, [1.0, None] * 4, "a"), (202, [float("nan")] * 8, "b"), (203, [float("-inf")] * 8, "b"), (204, [], "b")]
    for entries in (16, 1000):
        assert found_codes(spark, rows, entries=entries) == plain_codes(rows, 4, entries, 4)
    # Equal distances, and parts of unequal length.
    ties = [(i, [float(i % 3), float(i % 2), 0.0, 1.0, 1.0, 0.0], "t") for i in range(40)]
    assert found_codes(spark, ties, entries=8) == plain_codes(ties, 4, 8, 4)


def test_codes_of_large_components(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3]) for _ in range(4)], "a") for i in range(60)] + [(99, [2e5, 1e5, -2e5, 0.0], "a")]
    assert found_codes(spark, rows, entries=6) == plain_codes(rows, 4, 6, 4)
    with pytest.raises(Exception, match="too large"):
        found_codes(spark, [(1, [1e30] * 4, "a")])


def test_bounds_hold_and_leave_few():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-2000, 2000, (256, 16)), rng.integers(-2000, 2000, (300, 16))
    cells = vector_codes.Cells(book)
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    least, most = cells.bounds(x)
    assert (least <= far).all() and (far <= most).all()
    assert (least <= most.min(axis=1)[:, None]).mean() < 0.5
    entry, d = vector_codes.nearest(x, cells)
    assert (entry == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()


def test_vectors_of_several_lengths_and_none(spark):
    rows = [(i, [float(i), 1.0] * (1 + i % 2), None) for i in range(20)]
    got = found_codes(spark, rows)
    short, long = (plain_codes(rows[k::2], 4, 256, 4) for k in (0, 1))
    total = sum(r[2] for r in (short + long).elements())
    assert got == Counter((i, c, e, total, h) for i, c, e, _, h in (short + long).elements())
    assert found_codes(spark, [(1, None, "a"), (2, [], None)]) == Counter()


def plain_phrases(rows, least, top=2000, share=80):
    import re

    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if not any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in cand.items()):
                rows.append((cut[0], a, " ".join(p), f[p[: cut[1]]], f[p[cut[1] :]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out |= {(lang, k + 1, p, a, l, r, n[lang], s) for k, (s, a, p, l, r) in enumerate(rows[:top])}
    return out


def found_phrases(docs, **more):
    rows = phrases.collocations(docs, **more).collect()
    assert len(rows) == len(set(rows))
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}


@pytest.mark.parametrize("width", [1 << 10, 1 << 16])
def test_phrases_equal_brute_force(spark, monkeypatch, width):
    rng = random.Random(width)
    words = ["The", "the", "of", "end", "übel", "ÜBEL", " x", "a-b", "漢字", "new", "york", "city"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "!", ", ", " \x0c"]) for _ in range(rng.randrange(60)))
    rows = [(text(), rng.choice(["en", "de", None])) for _ in range(120)] + [(None, "en"), ("", None), ("new york city " * 40, "en"), (" .!. ", "fr")]
    docs = spark.createDataFrame([(i, t, lang, i, 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n long, rank int").repartition(6)
    # Sketches of several steps a task, with cells that collide.
    monkeypatch.setattr(phrases, "STEP_BYTES", 300)
    assert found_phrases(docs, least=3, sketch_width=width) == plain_phrases(rows, 3)
    assert found_phrases(docs, least=3, top=5, sketch_width=width) == plain_phrases(rows, 3, top=5)
    assert found_phrases(docs, least=300, sketch_width=width) == plain_phrases(rows, 300)


def test_sketches_rule_out_and_lose_nothing():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in rng.zipf(1.3, 20_000) % 5000).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text], pa.binary())], ["lang", "text"])
    rows = [r for out in phrases._sketch(1 << 16, 4, 30)(iter([batch])) for r in out.to_pylist() if r["row"] >= 0]
    blocks = pa.RecordBatch.from_pylist(sorted(({k: r[k] for k in ("row", "block", "cells")} for r in rows), key=lambda r: (r["row"], r["block"])))
    bits = np.zeros((2, (1 << 16) // 8), np.uint8)
    for out in phrases._merged(30)(iter([blocks])):
        for r in out.to_pylist():
            bits[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    sent = type("Sent", (), {"value": bits})()
    got = Counter()
    for out in phrases._survivors(sent, 4)(iter([batch])):
        for r in out.to_pylist():
            got[r["phrase"]] += r["times"]
    w = text.decode().split()
    all_of = Counter(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {p for p, n in all_of.items() if n >= 30}
    assert often <= set(got) and all(got[p] == all_of[p] for p in got) and len(got) < 0.05 * len(all_of)


def test_phrases_on_odd_and_empty_tables(spark, odd):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert found_phrases(odd) == plain_phrases(rows, 30)
    assert found_phrases(odd.where("false")) == set() == found_phrases(odd.where("text is null"))
