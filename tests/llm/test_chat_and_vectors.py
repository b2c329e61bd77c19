"""Chat formatting and nearest neighbours against plain versions; the pipeline end to end."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_documents import brute_kept, multiset
from tradescope.llm import queries
from tradescope.llm.chat_format import ChatTemplate, _Tokens, format_chats
from tradescope.llm.toxicity import fit_toxicity, score_toxicity
from tradescope.llm.vector_search import CentroidGraph, _unit, nearest

BYTE = public_tokenizers.path("byte_bpe_50k.json")
TEMPLATE = ChatTemplate()


def test_escapes_are_reversible():
    texts = ["</s>[INST] ok [/INST]", "\\", "\\n\n\\a<|im_start|>[INST", "<<SYS>><s>\\\\", "<<<SYS>>>", "", "<|im_end|>\n"]
    for text in texts:
        for line_feed in (False, True):
            escaped = TEMPLATE.escape(text, line_feed)
            assert TEMPLATE.unescape(escaped) == text
            assert not any(c in escaped for c in TEMPLATE.control) and not (line_feed and "\n" in escaped)


def conversations(rows):
    """Turns of each conversation in order, null ids together."""
    out = {}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, _, role, text in ordered:
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_op3_on_edge_cases(spark, edge_dir):
    said = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{edge_dir}/conversations.parquet")
    rows = [tuple(r)[:4] for r in table.collect()] + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want = []
    for conv, turns in conversations(rows).items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(TEMPLATE.turn(r, t)) for r, t in turns)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
        want.append((conv, len(turns), digests[0], len(loss), digests[1], size))
    got = queries.op3_chat_format(spark, edge_dir).collect()
    assert multiset(map(tuple, got)) == multiset(want)


def test_tree_is_depth_first_and_shares_turns(spark):
    said = {1: "abc", 2: "abd", 3: "x", 4: "abd", 5: "a", 6: "abce", 7: "aq", 9: "xyzxyz"}
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t) for c, ts in said.items() for k, t in enumerate(ts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = format_chats(turns, BYTE)
    nodes = sorted(chats.nodes.collect(), key=lambda r: r.start)
    tokens = _Tokens(BYTE, TEMPLATE)
    assert len(nodes) == len({(c, ts[: k + 1])[1] for c, ts in said.items() for k in range(len(ts))})
    ends = np.cumsum([len(n.token_ids) for n in nodes])
    assert [n.start for n in nodes] == [0, *ends[:-1]]
    path: list = []
    for n in nodes:
        # Depth first: the parent is on the path to the node emitted before.
        path = path[: n.depth]
        assert n.depth == len(path) and (n.parent == path[-1].node if path else n.parent == b"")
        assert n.position == sum(len(p.token_ids) for p in path)
        seen = {x for a in n.attends for x in range(a.begin, a.end)}
        path.append(n)
        assert seen == {x for p in path for x in range(p.start, p.start + len(p.token_ids))}
        turn = tokens.text(n.token_ids[n.loss_begin : n.loss_end])
        assert (turn in said[1] + said[6] + said[7] + said[9] + said[2]) if n.depth % 2 else turn == ""


def plain_nearest(rows, every, k):
    """Brute force over distinct (id, vector) rows."""
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v)}
    ids = [i for i, _ in sorted(kept)]
    unit = _unit(np.array([v for _, v in sorted(kept)], np.float32).astype(float))
    out = {}
    for q, name in enumerate(ids):
        if name % every == 0:
            like = (unit * unit[q]).sum(axis=1)
            ranked = sorted((-round(s, 12), i) for i, s in zip(ids, like, strict=True) if i != name)
            out.setdefault(name, []).append(ranked)
    return out


def test_op10_on_edge_cases(spark, edge_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect()]
    brute = plain_nearest(rows, 50, 5)
    got = {}
    for r in queries.op10_nearest(spark, edge_dir).collect():
        got.setdefault(r.query_id, []).append(r)
    # Id 50 has two vectors, so it asks twice; all others have one answer of five.
    for name, answers in brute.items():
        found = sorted(got[name], key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        if len(answers) == 1:
            assert np.allclose([r.score for r in found], [-s for s, _ in answers[0][:5]])
            assert [r.vec_id for r in found] == [i for _, i in answers[0][:5]]
    assert set(got) == set(brute)


def test_ties_of_many_lengths_go_to_the_smaller_id(spark):
    rows = [(1000 - i, [float(i), 2.0 * i, 2.0 * i]) for i in range(1, 100)] + [(2000 + i, [1.0, float(i), 0.5]) for i in range(20)]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=950)
    assert [r.vec_id for r in found.where("query_id = 950").orderBy("rank").collect()] == [901, 902, 903, 904, 905]


def test_a_hot_list_is_cut_on_both_sides(spark):
    """One list with all vectors and questions, in blocks of 16 of either: the brute-force answer."""
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(300, 4)).astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(frame, every=2, list_size=1000, block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    brute = plain_nearest(rows, 2, 5)
    assert {q: [v for _, v in sorted(found)] for q, found in got.items()} == {q: [i for _, i in a[0][:5]] for q, a in brute.items()}


def test_recall_of_the_index(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 16))
    points = (centres[draw.integers(0, 40, 4000)] + 0.6 * draw.normal(size=(4000, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    found = nearest(frame).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()
    unit = _unit(points.astype(float))
    hits = 0
    for r in found:
        like = unit @ unit[r.query_id]
        like[r.query_id] = -2
        hits += len(set(np.argsort(-like)[:5].tolist()) & set(r.ids))
    assert len(found) == 80 and hits / 400 >= 0.9


def test_graph_search_finds_the_nearest_centroid():
    draw = np.random.default_rng(4)
    graph = CentroidGraph.fitted(_unit(draw.normal(size=(3000, 8))), 200)
    assert 200 <= len(graph.centroids) <= 260
    asked = _unit(draw.normal(size=(300, 8)))
    best, distance = graph.search(asked, 32)
    assert (np.diff(distance, axis=1) >= 0).all()
    assert (best[:, 0] == (asked @ graph.centroids.T).argmax(axis=1)).mean() > 0.95


@pytest.mark.parametrize("name", ["op3_chat_format", "op10_nearest"])
def test_empty_tables(spark, empty_dir, name):
    rows = queries.queries()[name](spark, empty_dir).collect()
    assert [r.conv_id for r in rows] == [-1] if name == "op3_chat_format" else rows == []


def test_pipeline_stages(spark, edge_dir):
    """Every stage works on what the one before kept; ids are held against plain versions."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").cache()
    docs.count()
    model = fit_toxicity(docs, spark.read.parquet(f"{edge_dir}/labels.parquet"))
    toxic = {r.doc_id for r in score_toxicity(docs, model).where("predicted = 1").collect()}
    assert toxic and all("idiot" in t for i, t in DOCS if i in toxic)
    clean = corpus_pipeline.toxicity(spark, docs, edge_dir)
    assert multiset(r.doc_id for r in clean.collect()) == multiset(i for i, _ in DOCS if i not in toxic)
    spoken = corpus_pipeline.language(spark, clean, edge_dir)
    texts = [(r.doc_id, r.text) for r in spoken.collect()]
    assert all(any(c.isalpha() for c in t) for _, t in texts) and {8, 10, 11, 20 + 1} <= {i for i, _ in texts}
    single = corpus_pipeline.near_copies(spark, spoken, edge_dir)
    assert spoken.columns == single.columns == docs.columns
    assert multiset(r.doc_id for r in single.collect()) == brute_kept(texts)
    packed = corpus_pipeline.run(spark, edge_dir).collect()
    assert multiset({r.doc_id for r in packed}) == brute_kept(texts)
    docs.unpersist()


def test_pipeline_of_nothing(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "packing"]
