"""A small table with every odd case the operators have to stand."""

import random

import pytest

EXTRA = "key string, node string, n_words string, kept string, spans string, hits string, ids string, _k1 string, n_lines string, `group` string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "light", "winter", "market", "garden", "Éclair", "straße", "niño", "to", "a"]
    return " ".join(r.choice(words) + r.choice(["", "", "s", "ed", str(r.randint(0, 99))]) for _ in range(n))


def build() -> list[tuple[int | None, str | None]]:
    line = "This very long line of a newsletter is repeated in many documents"
    base = prose(1, 120)
    item = prose(77, 30)
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "\n\n\n"), (4, "a"), (5, "one two three"), (6, "One  two\tTHREE"),
        (7, base), (8, base), (9, base.upper()), (10, base.replace("river", "rivers", 2)), (11, base.replace("stone", "rock", 40)),
        (12, prose(2, 60) + "\n" + base), (13, "x" * 50_000), (14, ("word " * 3000).strip()), (15, prose(3, 4000)),
        (16, prose(3, 4000) + " end"), (17, prose(4, 200) + " " + item + " " + prose(5, 100)), (18, item), (19, item + " " + prose(6, 5)),
        (20, "mail a.b+c@x-y.example.org, or b@c.d_e@f.g; 10.0.0.255 and 1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.2.3.4"),
        (21, "card 4111 1111 1111 1111 or 4111111111111112, phone +1 (415) 555-0100 or +44 20 7946 0958."),
        (22, "aaaa@ bbb@ccc ddd@e.f" + "." * 30 + "@" * 30 + "+1" * 30), (23, "1" * 3000 + "." + "2 " * 500),
        (24, "the end <|endoftext|> it's they'll ''s 'S don't   two  spaces \n\n\ttab é́ 日本語 🎉 ½²"),
        (25, "ZERO\u0000WIDTH  nbsp em\u0085next\u001cfs"),
        *[(30 + i, f"{prose(100 + i, 30)}\n  {line.upper() if i % 2 else line}  \n{prose(200 + i, 10)}\n{line}") for i in range(7)],
        (7, base), (5, prose(9, 25)), (None, base), (None, None), (None, f"{line}\n{line}"), (-3, prose(10, 30)),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return build()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The table with columns whose names clash with those the operators make."""
    width = EXTRA.count(",") + 1
    return spark.createDataFrame([(i, t, *[None if i == 4 else "x"] * width) for i, t in rows], f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [(1, prose(77, 30)), (2, prose(77, 30)), (3, "one two THREE"), (None, prose(4, 20)), (5, None), (6, ""), (7, "--- !!!")]
    return items, spark.createDataFrame(items, "item_id long, text string")
