import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from railspark.llm.common import ship
    from railspark.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8, app="railspark-tests")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, nulls, empty and long texts, repeated ids, clashing extra columns."""
    import random
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    base = [" ".join(word() for _ in range(n)) for n in (3, 60, 120, 4000, 90, 90)]
    passage = " ".join(word() for _ in range(70))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[1].upper()), (21, base[1]), (22, base[2] + " tail"), (23, "x " + base[2]), (24, passage + " " + base[4]),
             (25, base[5] + "\n" + passage + "\nend"), (26, None), (27, ""), (28, "\u00a0 \t\n"), (29, "<|endoftext|> a<|endoftext|>"),
             (30, "a a a a a a\n\na a a a a a"), (30, "a a a a a a\n\na a a a a a"), (31, "z" * 20000), (32, "ab" * 150), (None, base[4])]
    return spark.createDataFrame([(i, t, "src" if i and i % 2 else None, "x", 1.0, 7) for i, t in rows],
                                 "doc_id long, text string, source string, kept string, score double, n_bytes int")
