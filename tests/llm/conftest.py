import random

import pytest


@pytest.fixture(scope="session")
def odd_folder(spark, tmp_path_factory):
    """Small tables with what can go wrong: nulls in any column, empty and long texts, ties, repeated rows, extra columns that clash."""
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "ünï", "x", "##", "12", "de|ta", "one", "two"]) + str(r.randrange(30))
    text = lambda n: "".join(word() + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))
    rows = [(i, text(r.randrange(0, 120)), r.choice(["en", "de", None]), r.choice(["web", "book", "code", "Zed", None]), 0, 1.5, 7) for i in range(150)]
    rows += [(i, rows[i - 150][1], "en", "web", 0, None, None) for i in range(150, 160)]
    rows += [rows[3], rows[3], (3, "another text for the same id " * 9, "en", "web", 0, 0.0, 1)]
    rows += [(200, None, "en", "web", 0, 0.0, 1), (201, "", None, None, 0, 0.0, 1), (202, " \n\t ", "de", "book", 0, 0.0, 1), (203, "a", "de", "book", 0, 0.0, 1)]
    rows += [(204, text(20_000), "en", "web", 0, 0.0, 1), (205, "line one is here\n" * 400, "en", "web", 0, 0.0, 1), (206, "wort " * 300, "de", None, 0, 0.0, 1)]
    folder = tmp_path_factory.mktemp("odd")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard int")
    frame.coalesce(2).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(0, 150, 2)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    talk = lambda n: [(r.choice(["user", "assistant", None]), r.choice(["hi", "yes ", "", None, "ünï", "no"])) for _ in range(n)]
    turns = []
    for c in [*range(-6, 60), 101, 104, 10**12 + 3]:
        if c % 7 != 3:
            turns += [(c, i if i % 4 else None, role, words, "extra", c) for i, (role, words) in enumerate(talk(r.randrange(1, 12)))]
    first = [(0, "user", "the same start"), (1, "assistant", "the same answer"), (2, "user", None)]
    turns += [(c, i, role, words, "extra", 0) for c in range(200, 260) for i, (role, words) in enumerate([x[1:] for x in first] * 4)]
    turns += [turns[5], turns[5], (None, 1, "user", "of no conversation", "", 0), (300, 1, "user", "x" * 50_000, "", 0)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, depth string, n_convs long").repartition(3).write.parquet(str(folder / "conversations.parquet"))
    unit = lambda: [r.gauss(0, 1) for _ in range(8)]
    near = lambda v, e: [x + r.gauss(0, e) for x in v]
    middle = [unit() for _ in range(12)]
    vectors = [near(middle[i % 12], 0.02) for i in range(90)] + [unit() for _ in range(30)] + [near(middle[0], 0.1) for _ in range(25)]
    vectors += [vectors[0]] * 4 + [[2 * x for x in vectors[1]], None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, unit()[:5], [1e-30] * 8, [1e30] * 8, [-0.0] * 8]
    rows = [(i if i % 37 else None, v, i % 3, "x") for i, v in enumerate(vectors)] + [(5, vectors[5], 0, "x"), (5, vectors[100], 0, "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").repartition(2).write.parquet(str(folder / "embeddings.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def empty_folder(spark, odd_folder, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{odd_folder}/{name}.parquet").where("false").write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)
