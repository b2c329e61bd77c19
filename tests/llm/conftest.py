"""Small tables full of edge cases, and empty ones."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def _prose(seed: int, n: int = 60) -> str:
    return " ".join(WORDS[(i * i * (seed + 3) + seed * i + i // 7) % len(WORDS)] for i in range(n))


#: doc_id, text; ids repeat, are null, and texts are null, empty, blank, equal, near or very long.
DOCS = [
    (1, None),
    (2, ""),
    (3, " \n\t  "),
    (4, "Hello world. Hello world."),
    (4, "Hello world. Hello world."),
    (5, "the <|endoftext|> end<|startoftext|>."),
    (None, "a text without id"),
    (6, "word " * 20_000 + "x" * 20_000 + "\n" + "ab" * 5_000),
    (7, "Étude Ñandú straße İstanbul ﬁn é 日本語 😀👩‍👩‍👧  \x85\xa0 \x1c\0end"),
    (8, _prose(8)),
    (9, _prose(8) + " nu"),
    (10, _prose(10)),
    (11, _prose(10)),
    (12, "123 456 !!! ???"),
    (13, "don't DON'T we'll\r\nthey're\n\n\nI'd"),
    (-5, "negative id"),
    *[(20 + i, f"{_prose(20 + i)}\n{_prose(50 + i)}. You are {'an idiot' if i % 3 == 0 else 'a friend'}.") for i in range(30)],
]
LANGS = ["en", "de", None]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    # The extra columns carry names that operators use for their own.
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, _row string, _print string, fingerprint int, block int, n_tokens string"
    rows = [(i, t, LANGS[k % 3], "s", 0, "x", "y", "r", "p", 1, 2, "z") for k, (i, t) in enumerate(DOCS)]
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(t is not None and "idiot" in t)) for i, t in DOCS] + [(20, 1, 1), (21, 1, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [
        *[(c, k, "user" if k % 2 == 0 else "assistant", f"t{k if k < 2 else c * k}") for c in range(12) for k in range(c % 5 + 1)],
        (20, 0, None, None), (20, 0, None, None), (20, None, "assistant", "<|im_end|>\n\\n[INST]"), (20, 1, "a\nb", "x" * 50_000),
        (None, 0, "user", "no id"), (None, 1, "assistant", ""),
        *[(30, k, "assistant", f"<s>{k}\n") for k in range(120)],
    ]
    spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, node string").write.parquet(f"{folder}/conversations.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [
        *[(i, [float(i * 7 % 13 - 6), float(i * i % 5), float(i % 3 - 1), 1.0]) for i in range(120)],
        (50, [1.0, 2.0, 3.0, 4.0]), (50, [1.0, 2.0, 3.0, 4.0]), (200, [0.0] * 4), (250, None), (300, [1.0, None, 0.0, 0.0]),
        (350, [nan, 1.0, 0.0, 0.0]), (400, [inf, 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (450, [1.0, 2.0]), (500, []),
        (550, [1e-30, 2e-30, 3e-30, 4e-30]), *[(600 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(60)],
    ]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{edge_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
