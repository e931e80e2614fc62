"""Documents with the awkward cases, written as the tables that queries read."""

import random

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket long, id long, keep_id long"


def sentences(seed: int, n: int, words: int = 60) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(words)).capitalize() + "." for _ in range(n)]


def rows(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, repeated rows, nulls, empty and very long texts."""
    base = sentences(seed, 40)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[3]) for i in range(30)]
    for i in range(40):
        words = base[5].split()
        for k in random.Random(i).sample(range(60), 1 + i % 4):
            words[k] = f"new{i}x{k}"
        out.append((200 + i, " ".join(words)))
    passage = " ".join(base[7].split()[10:40])
    out += [(300 + i, f"{sentences(900 + i, 1, 20)[0]} {passage} {sentences(990 + i, 1, 20)[0]}") for i in range(8)]
    out += [(400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "two words"), (405, "Two WORDS"), (406, LONG), (407, LONG), (408, LONG + " tail"), (409, "x" * 30_000), (7, base[7]), (None, base[8]), (None, None)]
    return out


def table(spark, values):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, "src", len(t or ""), "digest", 1, 2, 3) for i, t in values], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, rows()).repartition(5)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(0, 300, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path
