"""Small tables with nulls, empty and very long texts, ties, repeats and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, size long, shard int, `key` string, `rank` int, bucket int, label string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(seed=1):
    """Rows of documents with extra columns that clash with names used inside."""
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 60)
    texts = [base, base, base.replace(" ", "  "), base + " tail words here", words(rng, 40) + "\n" + passage + "\n" + words(rng, 30), passage, words(rng, 3), "", None, "   \n\t ", "one", words(rng, 60).upper(), words(rng, 4000), "é" * 300 + " " + words(rng, 55)]
    texts += [passage + " " + words(rng, 20) for _ in range(6)] + ["\n".join([words(rng, 12)] * 9), words(rng, 70).replace(" ", "### ")]
    near = base.split()
    for _ in range(8):
        new = near[:]
        new[rng.randrange(len(new))] = "changed"
        texts.append(" ".join(new))
    texts += [words(rng, rng.randint(5, 90)) for _ in range(30)]
    rows = [(i * 3, t, "en" if i % 2 else None, ["s1", "s2", None][i % 3], len(t or ""), "h", 1, 2, "k", 3, 4, "l") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base, "en", "s1", 1, "h", 1, 2, "k", 3, 4, "l"), (None, None, None, None, None, None, None, None, None, None, None, None)]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
