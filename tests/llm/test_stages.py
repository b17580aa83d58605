"""The operators as stages: rows and columns that they keep, whatever these are named, and what they do on odd tables."""

import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from conftest import DATA
from odd_rows import odd  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from stepwise.llm import exact_dedup, line_dedup, maxscore
from stepwise.llm.exact_dedup import drop_copies, exact_groups
from stepwise.llm.mixing import mixed, mixture
from stepwise.llm.shared import bitmap, in_bitmap
from stepwise.llm.simhash import drop_near_copies
from stepwise.llm.toxicity import drop_toxic
from stepwise.llm.warc import archive_roundtrip

HELPERS = "_n _copy _Text_check _text_sha _check _epochs _toxicity_score score r ID no_id sha check met turn stays place part epoch gone key cut equals whole domain n_tokens".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose other columns are named like anything that the operators add."""
    texts = ["one text of some words", "one text of some words", "another text of many other words here", "ein Text auf Deutsch", "", None, "a toxic word", "one text of some words!"]
    rows = [(i, t, ["en", "de"][i % 2], f"web{i % 3}", *[100 * i + j for j in range(len(HELPERS))]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[2:3], "doc_id long, text string, lang string, source string, " + ", ".join(f"{h} long" for h in HELPERS))


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, toxic int, text string, score double")


STAGES = {
    "exact": drop_copies,
    "near": drop_near_copies,
    "mixed": mixed,
    "lines": line_dedup.without_repeated_lines,
    "toxic": lambda docs: drop_toxic(docs, no_labels(docs.sparkSession)),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_no_column_is_overwritten(clashing, name):
    out = STAGES[name](clashing)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    given = {r["doc_id"]: tuple(r)[2:] for r in clashing.collect()}
    rows = out.collect()
    assert rows and all(tuple(r)[2:] == given[r["doc_id"]] for r in rows)


def whole(rows, fields=slice(None)):
    return Counter(tuple(r)[fields] for r in rows)


def test_copies_and_near_copies_leave_whole_rows(odd):
    given = whole(odd.collect())
    kept = whole(drop_copies(odd).collect())
    texts = Counter(r[1] or "" for r in kept.elements())
    assert not kept - given and set(texts.values()) == {1} and set(texts) == {t[1] or "" for t in given}
    assert max(t[0] for t in given if t[1] == "one") in {t[0] for t in kept}
    near = whole(drop_near_copies(odd).collect())
    assert not near - given and max(near.values()) == 1 and {t[0] for t in near} >= {0, 5, 8}


def test_mixed_draws_the_rows_of_mixture(spark):
    rng = random.Random(3)
    rows = [(1, "eight words are in this text you see", "en", "web1", 0)] * 10
    rows += [(i, " ".join(["w"] * rng.randrange(9)), rng.choice(["en", "de", None]), rng.choice(["web1", "web2", None]), i) for i in range(2, 300)]
    rows += [(500, "again and again", "de", "web2", 1)] * 700 + [(None, None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch long").repartition(7)
    for per_mille in (100, 450, 800, 1700):
        a, b = mixture(docs, per_mille=per_mille), mixed(docs, per_mille=per_mille)
        assert Counter(r["doc_id"] for r in a.collect()) == Counter(r["doc_id"] for r in b.collect())
        total = docs.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
        assert a.agg(F.sum("n_tokens")).first()[0] <= total * per_mille // 1000
    ten = spark.createDataFrame(rows[:10], docs.schema).repartition(3)
    assert mixture(ten).count() == mixed(ten).count() == 8


def test_ties_at_the_cut_of_a_mixture(spark):
    docs = spark.createDataFrame([(i, f"{'w ' * 4}x{i % 2}", "en", "web1") for i in range(20)] * 2, "doc_id long, text string, lang string, source string")
    got = Counter(r["doc_id"] for r in mixture(docs, per_mille=525).collect())
    assert sum(got.values()) == 21 and sorted(got.values()) == [1] + [2] * 10


def test_recipes_of_any_script_keep_their_chunks(spark):
    rng = random.Random(1)
    for letters in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてと", "".join(chr(0x4E00 + i) for i in range(3000))):
        words = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(2000)]
        text = " ".join(rng.choices(words, k=6000))
        rows = exact_dedup.recipes(spark.createDataFrame([(1, text), (2, "xy" + text)], "doc_id long, text string")).collect()
        a, b = (set(r["ids"]) for r in sorted(rows, key=lambda r: r["doc_id"]))
        assert len(a) > 30 and len(a & b) > 0.9 * len(a)


def test_groups_come_from_the_identifiers(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "doc_id long, text string")
    # Recipes that lie about what the chunks are must not pass for equality.
    lying = exact_dedup.recipes(docs).withColumn("ids", F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(exact_dedup, "recipes", lambda *_: lying)
    with pytest.raises(Exception, match="one recipe"):
        exact_groups(docs).collect()


def test_lines_of_one_short_identifier_stay_apart(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    roots = lambda rows: {frozenset(v) for v in groups(rows).values()}

    def groups(rows):
        out = {}
        for r in rows:
            out.setdefault(r["component_id"], set()).add((r["doc_id"], r["line_no"]))
        return out

    a, b = line_dedup.dedup_lines(docs).collect(), line_dedup.dedup_lines(docs, id_bits=8).collect()
    assert roots(a) == roots(b) and {(r["doc_id"], r["line_no"]) for r in a if r["kept"]} == {(r["doc_id"], r["line_no"]) for r in b if r["kept"]}


def test_lines_of_one_template_find_their_pairs(spark):
    """2000 pairs at a similarity of 0.82 on one template; all others are below 0.8."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    head = word(104)
    pairs = [(head + own + word(12), head + own + word(12)) for own in (word(8) for _ in range(2000))]
    assert 0.8 < line_dedup.jaccard(*pairs[0]) < 0.83 and line_dedup.jaccard(pairs[0][0], pairs[1][0]) < 0.8
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string").repartition(8)
    of = {}
    for r in line_dedup.dedup_lines(docs).collect():
        of.setdefault(r["doc_id"], []).append(r["component_id"])
    assert sum(a == b for a, b in of.values()) >= 0.99 * len(pairs)


def test_maxscore_looks_at_fewer_postings():
    rng = np.random.default_rng(5)
    w = np.floor(256 * rng.normal(size=(3000, 32)) / 6 * rng.gamma(1, 1, size=(1, 32))).astype(np.int64)
    ids, queries = np.arange(3000), w[::50]
    seen = 0
    shards = [maxscore.Shard(ids[at : at + 1000], np.ascontiguousarray(w[at : at + 1000].T)) for at in range(0, 3000, 1000)]
    floors = maxscore.floors(queries, ids[::50], w[:200], ids[:200], 5)
    for q, own, floor in zip(queries, ids[::50], floors, strict=True):
        found = maxscore.Found(5, floor)
        seen += sum(maxscore.search(q, own, s, found) for s in shards)
        scores = w @ q
        scores[own] = -(1 << 60)
        assert found.ids.tolist() == np.lexsort((ids, -scores))[:5].tolist()
    assert seen < 0.7 * len(queries) * w.size


def test_bit_maps_are_sized(spark):
    for n in (0, 10, 100_000):
        df = spark.range(n).select(F.xxhash64("id").alias("h"))
        words = bitmap(df, "h")
        held = np.array([r["h"] for r in df.collect()], np.int64)
        others = np.array([r["h"] for r in spark.range(1_000_000, 1_020_000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
        assert in_bitmap(words, held).all() and in_bitmap(words, others).mean() < 0.13
    assert in_bitmap(None, held).all()


def test_pipeline_on_odd_and_empty_documents(spark, odd, tmp_path):
    labels = spark.createDataFrame([(0, 1, None)], "doc_id long, toxic int, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    folder = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    there = set(Path(folder, "stepwise").glob("*"))
    result = corpus_pipeline.run(spark, str(tmp_path))
    # Of all that was staged only the result is left.
    left = set(Path(folder, "stepwise").glob("*")) - there
    assert [p.name.partition("-")[0] for p in left] == ["BPE"]
    got = result.collect()
    assert got and {r["doc_id"] for r in got} <= {r["doc_id"] for r in odd.collect()}
    empty = tmp_path / "empty"
    labels.where("false").write.parquet(f"{empty}/labels.parquet")
    odd.where("false").write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_other_columns_of_vectors_and_pages(spark):
    rows = [(i, [float(i % 7), float(i % 3) + 1], i, "x") for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")
    plain, more = ({tuple(r) for r in maxscore.top_k(v).collect()} for v in (vectors.select("vec_id", "embedding"), vectors))
    assert plain == more and len(plain) == 15
    pages = spark.createDataFrame([(1, "u", "x" * 200, "d", 1), (2, "u", "x" * 200, "d", 2)], "page_id long, url string, html string, digest string, n int")
    assert {(r["page_id"], r["refers_to"]) for r in archive_roundtrip(pages).collect()} == {(1, None), (2, 1)}


def test_many_shared_pages_keep_their_payloads(spark):
    """More single pages than the smallest bit map holds apart, so that some count as shared at first."""
    rows = [(i, f"u{i}", f"{'page ' * 30}{i if i % 3 else i % 30}") for i in range(6000)]
    got = {r["page_id"]: r for r in archive_roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    for i, _, html in rows:
        r = got[i]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[html] == i else ("revisit", first[html]))
        assert r["record_type"] == "revisit" or bytes(r["block"]).decode() == html


def test_scores_beyond_64_bits_raise(spark):
    vectors = lambda x: spark.createDataFrame([(i, [x, -x, x * (i % 7)]) for i in range(60)], "vec_id long, embedding array<double>")
    assert maxscore.top_k(vectors(1e5)).count() == 10
    for x in (3e7, 1e30):
        with pytest.raises(Exception, match="too large"):
            maxscore.top_k(vectors(x)).collect()
