"""The training-data operators: against SQL, brute force, exact round trips or held-out accuracy, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from conftest import DATA, same_as_sql
from odd_rows import ODD_TEXTS, odd  # noqa: F401
from pyspark.sql import functions as F

from stepwise.llm import line_dedup
from stepwise.llm.bpe import encoded
from stepwise.llm.components import connected_components
from stepwise.llm.exact_dedup import drop_copies, exact_groups
from stepwise.llm.language_id import languages
from stepwise.llm.license_scan import scan
from stepwise.llm.maxscore import top_k
from stepwise.llm.mixing import mixed, mixture
from stepwise.llm.queries import ORACLES, QUERIES
from stepwise.llm.simhash import drop_near_copies, near_components
from stepwise.llm.toxicity import drop_toxic, toxicity
from stepwise.llm.warc import archive_roundtrip, read_archive, write_archive

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 1), (0, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


def texts(spark, folder=SMALL):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


SIZES = pytest.mark.parametrize("folder", [SMALL, f"{DATA}/sf0.01"])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert same_as_sql(QUERIES[name](spark, f"{DATA}/sf0.01"), "sf0.01", ORACLES[name])


ON_DOCS = {
    "op1": scan,
    "op2": exact_groups,
    "op3": line_dedup.dedup_lines,
    "op5": mixture,
    "op6": near_components,
    "op8": encoded,
    "op9": languages,
}


@pytest.mark.parametrize("name", sorted(ON_DOCS))
def test_odd_and_empty_tables(spark, odd, name):
    rows = ON_DOCS[name](odd).collect()
    if name not in ("op3", "op5"):
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert ON_DOCS[name](odd.where("false")).collect() == []


@pytest.mark.parametrize("stage", [drop_copies, drop_near_copies, mixed, line_dedup.without_repeated_lines])
def test_stages_keep_the_columns(odd, stage):
    out = stage(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd.collect()}
    assert stage(odd.where("false")).count() == 0


def test_toxicity_on_odd_rows(odd, labels):
    rows = toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity(odd.where("false"), labels.where("false")).count() == 0
    assert drop_toxic(odd, labels.where("false")).collect() == odd.collect()


def test_exact_dedup_numbers_chunks_whose_hashes_clash(odd):
    plain = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(odd).collect()}
    one_hash = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(odd, lambda c: F.length(c).cast("long") % 2).collect()}
    assert plain == one_hash


def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent)}


def test_connected_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 9), (20, 3), (4, None)] + [(i, i + 1) for i in range(100, 180)]
    got = connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    want = roots([x for x in links if x[1] is not None and x[0] != x[1]])
    assert {r["node"]: r["root"] for r in got} == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@SIZES
def test_line_components_equal_brute_force(spark, folder):
    lines = sorted({x for _, t in texts(spark, folder) for x in line_dedup.normal_lines(t or "") if x})
    ids = [line_dedup.line_id(x) for x in lines]
    sets = [line_dedup.shingles(x) for x in lines]
    holders = defaultdict(list)
    links = []
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        links += [(ids[i], ids[j]) for j, n in shared.items() if n / (len(s) + len(sets[j]) - n) >= line_dedup.SIMILAR]
        for g in s:
            holders[g].append(i)
    want = roots([*links, *((i, i) for i in ids)])
    got = QUERIES["op3_line_dedup"](spark, folder).collect()
    mine = {r["line_id"]: r["component_id"] for r in got}
    assert len(set(mine.values())) == len(set(want.values()))
    assert len({(mine[i], want[i]) for i in ids}) == len(set(want.values()))
    assert sum(r["kept"] for r in got) == len(set(want.values()))


@pytest.mark.parametrize("block", [line_dedup.BLOCK, 300])
def test_line_components_of_hot_keys_equal_brute_force(spark, monkeypatch, block):
    """6000 lines with one head: two that are similar often share hot keys only."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    head = word(60)
    lines = [head + own + word(4) for own in (word(10) for _ in range(3000)) for _ in range(2)]
    ids = [line_dedup.line_id(x) for x in lines]
    tails = [line_dedup.shingles(x) - line_dedup.shingles(head) for x in lines]
    # All share the head's shingles; who shares more is found by the tails'.
    common, holders, links = len(line_dedup.shingles(head)), defaultdict(list), []
    keys = [set(k) for k in line_dedup.band_keys(lines).tolist()]
    assert max(Counter(k for x in keys for k in x).values()) > 1000 and common / (common + 2 * min(map(len, tails))) < line_dedup.SIMILAR
    for i, tail in enumerate(tails):
        for j, n in Counter(j for g in tail for j in holders[g]).items():
            if (common + n) / (common + len(tail) + len(tails[j]) - n) >= line_dedup.SIMILAR and keys[i] & keys[j]:
                links.append((ids[i], ids[j]))
        for g in tail:
            holders[g].append(i)
    want = roots([*links, *((i, i) for i in ids)])
    docs = spark.createDataFrame([(i, "\n".join(lines[i::40])) for i in range(40)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).collect()
    assert len(links) > 2900 and {r["line_id"]: r["component_id"] for r in got} == want
    assert sum(r["kept"] for r in got) == len(set(want.values()))


def test_line_similarity_is_exact():
    pairs = [("ab", "ab"), ("ab", "abc"), ("abcdefgh", "abcdefgh"), ("a" * 100, "a" * 50), ("the quick brown fox jumps over", "the quick brown fox jumped over")]
    a, b = zip(*pairs, strict=True)
    assert line_dedup.similar(list(a), list(b), 0.8) == [line_dedup.jaccard(x, y) >= 0.8 for x, y in pairs]
    assert line_dedup.similarities(list(a), list(b)).tolist() == pytest.approx([line_dedup.jaccard(x, y) for x, y in pairs])


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@SIZES
def test_simhash_components_equal_brute_force(spark, folder):
    prints = {i: plain_fingerprint(t) for i, t in texts(spark, folder)}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k:] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(links)
    got = QUERIES["op6_simhash_near_dedup"](spark, folder).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_bpe_equals_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def row(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    for df in (spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), odd):
        want = Counter(row(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r) for r in encoded(df).collect()) == want


def test_top_k_blocks_and_odd_vectors(spark):
    rows = [(i, [float((i * 37 + j * 11) % 19 - 9) / 7 for j in range(6)]) for i in range(300)] + [(50, [1.0] * 6), (7, None), (8, [None] * 6), (9, [float("nan")] * 6), (None, [1.0] * 6), (1000, []), (100, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole, parts = ({tuple(r) for r in top_k(df, **o).collect()} for o in ({}, {"shard_rows": 16, "query_rows": 2}))
    assert whole == parts and {r[1] for r in whole} == {1, 2, 3, 4, 5}
    assert top_k(df.where("false")).count() == 0


def test_warc_round_trip_of_odd_pages(spark):
    big = "x" * 150
    rows = [(1, "u1", big), (2, None, big), (3, "u\r\n3", None), (None, "u4", big), (5, "u5", "small"), (6, "u6", "small"), (1, "u1", big), (7, "u7", "ü漢" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archive_roundtrip(pages).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(1, "response", None), (2, "revisit", 1), (3, "response", None), (None, "revisit", 1), (5, "response", None), (6, "response", None), (1, "response", None), (7, "response", None)]
    )
    assert {r["page_id"]: r["payload_bytes"] for r in got}[7] == len("ü漢".encode()) * 100
    assert archive_roundtrip(pages.where("false")).count() == 0


def test_warc_reads_selected_records_only(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    index = write_archive(pages, f"file://{tmp_path}/archive")
    some = read_archive(index.where("page_id % 7 = 0")).collect()
    want = {r["page_id"]: r["html"] or "" for r in pages.where("page_id % 7 = 0").collect()}
    assert {r["page_id"] for r in some} == set(want)
    assert all(bytes(r["block"]).decode() == want[r["page_id"]] for r in some if r["record_type"] == "response")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_language_id"](spark, f"{DATA}/sf0.01").join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op10_toxicity"](spark, f"{DATA}/sf0.1").join(labels, "doc_id").where("held_out and toxic is not null")
    rates = {r["toxic"]: r["p"] for r in got.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] > 0.75 and rates[0] < 0.05


def test_pipeline_equals_its_parts_in_plain_python(spark):
    import corpus_pipeline

    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # Scores have no plain form here; all that follows has.
    clean = {r["doc_id"] for r in QUERIES["op10_toxicity"](spark, SMALL).where("predicted = 0").collect()}
    best = {}
    for i, t in texts(spark):
        if i in clean:
            best[t or ""] = max(i, best.get(t or "", i))
    left = {i: t for t, i in best.items()}
    prints = {i: plain_fingerprint(t) for i, t in left.items()}
    ids = sorted(left)
    root = roots([(a, b) for k, a in enumerate(ids) for b in ids[k:] if (prints[a] ^ prints[b]).bit_count() <= 2])
    stay = docs.where(F.col("doc_id").isin(sorted(set(root.values()))))
    assert got == Counter(r["doc_id"] for r in mixture(stay).collect())
    assert set(got) <= set(root.values())
