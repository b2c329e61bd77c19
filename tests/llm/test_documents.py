"""Near copies, toxicity, language and fingerprints against brute force."""

import bisect
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import DOCS
from tradescope.llm import queries
from tradescope.llm.fingerprints import deleted, fingerprint, inserted, likeness, written
from tradescope.llm.language_id import fit_language_filters, identify_languages, keep_identified
from tradescope.llm.simhash_dedup import VantageTree, keep_one, leaf_links, simhash
from tradescope.llm.toxicity import Bags, ToxicityModel, drop_toxic, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"


def multiset(rows):
    return sorted(rows, key=repr)


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_simhash(text: str, width: int) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash():
    for text in ("", " \x0b ", "one", "A b C d", "a b c d e f g a b c d", "É x\x85y z w v", "the " * 50):
        for width in (4, 5):
            assert simhash(text, width) % 2**64 == plain_simhash(text, width)


def test_trees_find_what_brute_force_finds():
    draw = np.random.default_rng(5)
    values = draw.integers(0, 2**64, 1500, dtype=np.uint64)
    near = values[:40].repeat(20)
    for _ in range(4):
        near = near ^ (np.uint64(1) << draw.integers(0, 64, len(near)).astype(np.uint64))
    values = np.unique(np.r_[values, near, np.uint64(0), np.uint64(3)])
    links = []
    for k in range(4):
        tree = VantageTree.grown(values, 16 * k, 0xFFFF, 1, 100)
        assert tree.leaves > 5
        for _, at, lives in tree.route(values):
            links += leaf_links(values[at][lives], values[at], 4)
    names = [int(v) for v in values]
    away = np.bitwise_count(values[:, None] ^ values[None, :])
    brute = [(names[a], names[b]) for a, b in zip(*np.nonzero(away <= 4), strict=True) if a < b]
    assert components(links, names) == components(brute, names)


def test_op7_on_edge_cases(spark, edge_dir):
    got = queries.op7_near_duplicates(spark, edge_dir).collect()
    prints = [plain_simhash(t or "", 4) for _, t in DOCS]
    pairs = [(a, b) for a, x in enumerate(prints) for b, y in enumerate(prints) if a < b and (x ^ y).bit_count() <= 4]
    roots = components(pairs, range(len(DOCS)))
    least = {}
    for k, (i, _) in enumerate(DOCS):
        known = [x for x in (least.get(roots[k]), i) if x is not None]
        least[roots[k]] = min(known) if known else None
    want = [(i, f"{p:016x}", least[roots[k]]) for k, ((i, _), p) in enumerate(zip(DOCS, prints, strict=True))]
    assert multiset(map(tuple, got)) == multiset(want)


def brute_kept(rows):
    """Rows that stay of (id, text): the least of every component of fingerprints within 4 bits."""
    prints = [plain_simhash(t or "", 4) for _, t in rows]
    pairs = [(a, b) for a, x in enumerate(prints) for b, y in enumerate(prints) if a < b and (x ^ y).bit_count() <= 4]
    roots = components(pairs, range(len(rows)))
    first = {}
    for k, (i, _) in enumerate(rows):
        rank = (i is None, i or 0, k)
        first[roots[k]] = min(first.get(roots[k], rank), rank)
    return multiset(r[1] if not r[0] else None for r in first.values())


def test_keep_one(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {(r.score, r["_row"], r["_print"]) for r in kept.collect()} == {("x", "r", "p")}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert multiset(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_keep_one_of_crowds_and_chains(spark):
    """Near copies of a few texts, each a few words from another one, so that some are linked only through others."""
    draw = np.random.default_rng(3)
    rows = []
    for group in range(6):
        words = [f"g{group}w{i}" for i in range(800)]
        for k in range(40):
            words = list(words)
            words[int(draw.integers(800))] = f"x{k}"
            rows.append((1000 * group + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    assert 6 <= len(want) < 200
    assert multiset(r.doc_id for r in keep_one(docs).collect()) == want


def test_op8_on_edge_cases(spark, edge_dir):
    got = queries.op8_toxicity(spark, edge_dir).collect()
    assert multiset(r.doc_id for r in got) == multiset(i for i, _ in DOCS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].score == by_id[2].score == 0.0 and by_id[3].score < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    right = [by_id[i].predicted == int("idiot" in t) for i, t in DOCS if i is not None and i >= 20]
    assert np.mean(right) > 0.9
    texts = {i: t for i, t in DOCS}
    named = [texts[r.doc_id][s.begin : s.end] for r in got for s in r.offending]
    assert named and all("idiot" in s for s in named)


def test_length_alone_is_not_toxic(spark, edge_dir):
    docs, labels = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    long = spark.createDataFrame([(1, "A day of rain.\n" * 100_000), (2, "A day of rain.\nYou are an idiot.")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in score_toxicity(long, model).collect()}
    assert score[1] == 0 and score[2] >= 0.3
    assert [r.doc_id for r in drop_toxic(long, model).collect()] == [1]


def test_features_come_from_all_labelled_rows(spark):
    rows = [(i, "you zlork" if i % 20 == 0 else "a calm day", int(i % 20 == 0)) for i in range(400)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(rows, rows.select("doc_id", "toxic"), sample=60)
    assert "zlork$" in model.feature
    assert fit_toxicity(rows, rows.selectExpr("doc_id", "0 AS toxic")).feature == {}


def test_features_need_so_many_toxic_documents(spark):
    rows = [(i, "you zlork" if i < 3 else "a calm day", int(i < 3)) for i in range(100)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = rows.select("doc_id", "toxic")
    assert fit_toxicity(rows, labels).feature == {} and "zlork$" in fit_toxicity(rows, labels, least_toxic=3).feature


def test_long_labelled_texts_do_not_bind_the_fit(spark):
    """Texts of a megabyte: the pairs of the fit stay within their bound, and the model still learns."""
    rows = [(i, ("you zlork. " if i % 4 == 0 else "a calm day. ") * (90_000 if i % 16 < 8 and i < 40 else 3), int(i % 4 == 0)) for i in range(200)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = fit_toxicity(rows, rows.select("doc_id", "toxic"), pairs=20_000)
    got = {r.doc_id: r.predicted for r in score_toxicity(rows, model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(200))


def test_scores_equal_a_plain_noisy_or(spark):
    model = ToxicityModel({"bad$": 0, "ba": 1, "bad": 2, "wor": 3}, np.array([1.5, -0.5, 0.25, 2.0]), -1.0)
    texts = ["", "Bad bad! A calm day. The worst, baddest\nBAR? word", "nothing here. at all", "é bad.\U0001f600 bad"]
    got = score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, threshold=0.5).collect()
    for r, text in zip(sorted(got), texts, strict=True):
        clear, spans, at = 1.0, [], 0
        for sentence in re.split("([.!?\n])", text):
            words = [w for w in re.split(r"[\W\d_]+", sentence.lower()) if w]
            found = [f for w in words for f in [w + "$", *(w[:k] for k in range(3, 8) if k < len(w))] if f in model.feature]
            if found:
                p = 1 / (1 + np.exp(-(model.bias + sum(model.weight[model.feature[f]] for f in found))))
                clear *= 1 - p
                if p >= 0.5:
                    spans.append((at, at + len(sentence), p))
            at += len(sentence)
        assert abs(r.score - (1 - clear)) < 1e-12 and r.predicted == int(r.score >= 0.5)
        assert [s[:2] for s in r.offending] == [s[:2] for s in spans]
        assert np.allclose([s[2] for s in r.offending], [s[2] for s in spans])


def test_gradient_of_the_noisy_or_equals_finite_differences():
    draw = np.random.default_rng(2)
    owner = np.sort(draw.integers(0, 12, 40))
    place = np.sort(draw.integers(0, 40, 150))
    bags = Bags(draw.integers(0, 2, 12).astype(float), owner, place, draw.integers(0, 6, 150))
    theta = draw.normal(0, 0.3, 7)
    _, gradient = bags.loss(theta, 0.01)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert abs((bags.loss(theta + step, 0.01)[0] - bags.loss(theta - step, 0.01)[0]) / 2e-6 - gradient[k]) < 1e-6


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.9
    assert sum(r.predicted for r in got if labels[r.doc_id] == 0) <= 0.03 * len(got)


def test_op2_on_edge_cases(spark, edge_dir):
    got = queries.op2_language_id(spark, edge_dir).collect()
    assert len(got) == len(DOCS)
    texts = {}
    for i, t in DOCS:
        texts.setdefault(i, t)
    for r in got:
        lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred in (("en", "de") if lettered else ("und",)) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)


def test_languages_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.op2_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.98


def test_more_than_64_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, f"{letters[k % 26]}{letters[k // 26]} " * 30, f"l{k:02}") for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = fit_language_filters(docs)
    assert filters.slots.shape[1] == 2
    found = {r.doc_id: r.lang_pred for r in identify_languages(docs, filters).collect()}
    assert all(found[k] == lang for k, _, lang in rows)
    assert keep_identified(docs, filters).count() == 70


def test_without_a_language_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    filters = fit_language_filters(docs)
    assert filters.languages == [] and [r.doc_id for r in keep_identified(docs, filters).orderBy("doc_id").collect()] == [1, 4]


def test_fingerprints_are_homomorphic():
    one, other = "x y z\nsome longer paragraph here\n\nlast", "last\nx y z\n\nsome longer paragraph here"
    assert written(fingerprint(one)) == written(fingerprint(other))
    assert inserted(written(fingerprint("x y z\nlast\nsome longer paragraph here")), "") == written(fingerprint(one))
    assert deleted(written(fingerprint(one)), "last") == written(fingerprint("x y z\nsome longer paragraph here\n"))
    assert written(fingerprint("a\na")) != written(fingerprint("a"))
    assert likeness(fingerprint(""), fingerprint("")) == 1 and likeness(fingerprint("a"), fingerprint("b")) < 1


def test_op9_on_edge_cases(spark, edge_dir):
    got = queries.op9_fingerprints(spark, edge_dir).collect()
    ordered = sorted(DOCS, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] is not None, d[1] or ""))
    texts = [t or "" for _, t in ordered]
    want = []
    for (i, _), t, after in zip(ordered, texts, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, following = fingerprint(t), fingerprint(edited), fingerprint(after)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want.append((i, len(t), digest, written(own), written(changed), likeness(own, changed), likeness(own, following)))
    assert multiset(map(tuple, got)) == multiset(want)


def test_op9_across_blocks(spark):
    """More documents than one block holds, so that neighbours meet across blocks."""
    docs = spark.range(900).selectExpr("id * 3 AS doc_id", "concat('text of ', id, repeat(' more', CAST(id % 7 AS int))) AS text")
    from tradescope.llm.fingerprints import compare_with_next

    got = {r.doc_id: r.edited_sha256 for r in compare_with_next(docs).collect()}
    texts = [f"text of {i}" + " more" * (i % 7) for i in range(900)]
    for i, t in enumerate(texts):
        after = texts[i - 1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[3 * i] == hashlib.sha256(edited.encode()).hexdigest()


def test_op9_with_hot_ids(spark, monkeypatch):
    """One id holds a third of the rows, one row is repeated without end, many rows have no id."""
    from tradescope.llm import fingerprints

    hot = [(7, f"hot text {i % 900}" if i % 3 else None) for i in range(1500)]
    copies = [(5, "the same again and again")] * 3000
    nameless = [(None, f"nameless {i}") for i in range(1200)]
    plain = [(i, f"plain {i}") for i in range(100, 400)]
    frame = spark.createDataFrame([*hot, *copies, *nameless, *plain], "doc_id long, text string").repartition(5)
    marks = {r.text: r.mark for r in frame.selectExpr("text", "xxhash64(text) AS mark").distinct().collect()}
    rows = [*hot, *copies, *nameless, *plain]
    rows.sort(key=lambda d: (d[0] is None, -(d[0] or 0), marks[d[1]], d[1] is not None, d[1] or ""))
    texts = [t or "" for _, t in rows]
    want = []
    for (i, _), t, after in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(fingerprint(t), fingerprint(after)), 9)))
    got = [
        (r.doc_id, r.n_chars, r.edited_sha256, round(r.near_next, 9)) for r in fingerprints.compare_with_next(frame).collect()
    ]
    assert multiset(got) == multiset(want)
    # No block holds more than twice its share, whatever the id.
    source = frame.selectExpr("doc_id AS id", "text", "xxhash64(text) AS mark")
    starts, crowds = fingerprints._blocks(source)
    places = sorted(fingerprints._place(i, marks[t]) for i, t in rows)
    light = [bisect.bisect_right(starts, p) for p in places if p not in crowds]
    assert len(crowds) == 2 and max(map(light.count, set(light))) <= 512 and len(starts) >= 9


@pytest.mark.parametrize("name", ["op2_language_id", "op7_near_duplicates", "op8_toxicity", "op9_fingerprints"])
def test_empty_tables(spark, empty_dir, name):
    assert queries.queries()[name](spark, empty_dir).count() == 0


def test_keep_one_of_nothing(spark, empty_dir):
    assert keep_one(spark.read.parquet(f"{empty_dir}/documents.parquet")).count() == 0
