import random

import pytest

pytest.importorskip("epochal.llm")


def make_docs(seed=5):
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, junk, nulls and long texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(60), prose(12)
    texts = [prose(rng.randint(30, 160)) for _ in range(30)]
    near = texts[3].split()
    for i in (10, 60):
        if i < len(near):
            near[i] = "changed"
    texts += [texts[0], texts[0], texts[1] + "\n" + line, " ".join(near), prose(20) + " " + passage + " " + prose(30), passage, prose(5) + "\n" + passage + "\t" + passage, line, line + "\n" + line + "\n" + line]
    texts += ["", " \n\t ", None, None, "a", "A b", "one two three", "One TWO three", "é" * 130, "é" * 130, "ab" * 300, "x\x0by\x0cz w", "ünï cödé " * 40, prose(4000), "same word " * 50, "%%% " + prose(30).replace(" ", "%%% ")]
    rows = [(i, t, "en", ["s1", "s2", "ß", None][i % 4] if i % 5 else "s1", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(docs):
    """Extra columns with the names of results and internal columns."""
    from pyspark.sql import functions as F

    names = ["blk", "ord", "id", "size", "kept", "n_words", "shard", "slot", "r", "g", "key", "range", "at", "target", "taken", "n_entities", "score", "component_id", "n_tokens", "b", "l"]
    return docs.withColumns({n: F.lit(7) for n in names})
