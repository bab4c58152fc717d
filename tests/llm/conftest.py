import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, row int, n string"


def document_rows() -> list[tuple]:
    """Null ids, texts, languages and sources; empty, blank, long and repeated texts; repeated rows; columns whose names the operators use."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "an", "re", "ing", "ou", "st", "é", "ß", "Thi"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ",", "."]) for _ in range(n))
    base = [text(rng.choice([1, 3, 4, 5, 12, 30, 60, 120])) for _ in range(30)]
    base[4] = "\n".join(text(30) for _ in range(4))
    base[5] = base[4] + " more"
    base[6] = "x" * 700 + " " + base[4]
    passage = text(50)
    texts = [*base, base[7], base[7] + "  ", base[8].replace(" ", "\n\t"), None, "", " ", "\n", "aaa" * 300, "ab " * 400, f"{text(9)}\n{passage}\n{text(5)}", f"{text(3)} {passage}", text(20_000)]
    edited = base[29].split(" ")
    for i in (3, 60, 110):
        texts.append(" ".join([*edited[:i], "zzz", *edited[i + 1 :]]))
    rows = [(i * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "", None]), 0 if t is None else len(t), i, "k", 1, "n") for i, t in enumerate(texts)]
    rows.append(rows[0])
    rows.append((None, base[1], None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
