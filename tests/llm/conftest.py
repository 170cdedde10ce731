import random

import pytest

SF, SF_MORE, SF_LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, ord long, kind string, _key string, bucket string"


def corpus(seed: int = 5) -> list[tuple[int, str | None]]:
    """Texts with nulls, empty ones, copies, near copies, shared passages and lines, many bytes a letter, and a long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß漢🙂") for _ in range(rng.randint(2, 7))) for _ in range(160)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [say(25) for _ in range(6)]
    lines = [say(6) for _ in range(12)] + ["short", "shirt", "a line of sixteen", "a line of sixteenn", "a line of sixtean"]
    texts: list[str | None] = [None, "", " \n\t ", "x", say(3), "Ünï\n\n" + say(30)]
    for _ in range(40):
        parts = [say(rng.randint(1, 30)), rng.choice(shared), rng.choice(lines), rng.choice(lines)[:-1] + rng.choice("xyz"), rng.choice(["", "!!!! #1", "A B C"])]
        rng.shuffle(parts)
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(parts))
    texts += [texts[10], texts[10] + " z", texts[12].upper(), "\n".join(["again and again and again"] * 9), say(9) * 4, "\n".join(say(7) for _ in range(1500)), None, ""]
    ids = rng.sample(range(1, 10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def wide(spark, docs):
    """A table of documents with further columns whose names operators use themselves."""
    rows = [(i, t, "en", None, len(t or ""), i, "line", "x", None) for i, t in docs]
    return spark.createDataFrame(rows, KINDS).repartition(3)


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return wide(spark, texts).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def real(spark):
    """The smallest tables: (documents, list of (doc_id, text))."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    return table, [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
