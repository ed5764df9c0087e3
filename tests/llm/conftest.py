import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, o int, t string, shard string, hits string, copies string, c0 string, _part int"


def _rows():
    """Documents with every awkward case: nulls, empties, repeated rows, copies, near copies, shared passages, periods, a long text, clashing columns."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = prose(70), prose(300)
    words = base.split()
    texts = [(i, prose(rnd.randint(1, 250))) for i in range(40)]
    texts += [(50 + i, f"{prose(30)} {passage} {prose(25)}") for i in range(6)]
    texts += [(60 + i, base) for i in range(5)]
    for i in range(5):
        near = list(words)
        near[rnd.randrange(300)] = f"other{i}"
        texts.append((70 + i, " ".join(near)))
    texts += [(80, None), (81, ""), (82, " \n\t"), (83, "one"), (84, "One"), (85, "For " * 400), (86, "For " * 350 + prose(40)), (87, "x" * 5000)]
    texts += [(88, prose(40_000)), (90, f"{passage}\n{passage}"), (91, texts[3][1]), (3, texts[3][1]), (3, texts[3][1]), (92, "ａ b\x1cc d <|endoftext|> don't İ")]
    texts += [(None, prose(50)), (None, base), (None, None), (95, "\x00" + prose(60)), (96, passage.upper())]
    sources = ["a", "b", "a", None, "ü", "c"]
    return [(i, x, "en" if k % 3 else None, sources[k % 6], None, k, "t", "s", "h", "c", "c0", k) for k, (i, x) in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench(spark, rows):
    passage = next(r[1] for r in rows if r[0] == 50).split()
    items = [(1, " ".join(passage[35:60])), (2, " ".join(passage[40:52])), (2, " ".join(passage[35:60])), (3, None), (4, "..!"), (None, " ".join(passage[80:95])), (5, "ONE"), (6, "never seen words here")]
    return spark.createDataFrame(items, "item_id long, text string")
