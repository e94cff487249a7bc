"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, spans int, kept boolean"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel iris juniper larch maple nettle oak pine quince rowan spruce teak umbra".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed=5):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(12)]
    passage = sentence(rng, 90)
    near = []
    for _ in range(6):
        parts = base[0].split()
        parts[rng.randrange(len(parts))] = "changed"
        near.append(" ".join(parts))
    odd = [
        None, "", " ", "\n\n", "a", "one two three four", "A b\tC\x0bd e f", "é" * 450, "日本語 " * 120, "x" * 5000, "ab" * 700, "The End. " * 60,
        "!!! ### $$$ &&& %%% *** @@@ ~~~ ^^^", "Home | News | Sport | More\n" + base[1], "We use cookies on this site\n" + base[2],
        "<|endoftext|> <s> </s> ▁ " + base[3], "tab\t\ttab  two  spaces \n \nend ", "   wide", base[4] + "\n" + base[4], "0 1 2 3",
        " ".join("w%d" % i for i in range(9000)),
    ]
    mixed = [sentence(rng, 40) + " " + passage + " " + sentence(rng, 40) for _ in range(5)]
    return base + near + odd + mixed + [base[0], base[0], base[5]]


def rows(seed=5):
    out = [(i, t, ["en", "de", None][i % 3], "src%d" % (i % 2), None if t is None else len(t), "r", "w", i, i % 2 == 0) for i, t in enumerate(texts(seed))]
    return out + [out[0], out[3]]


def docs(spark, seed=5):
    return spark.createDataFrame(rows(seed), DOCS).repartition(3, "n_chars")


def empty(spark):
    return spark.createDataFrame([], DOCS)
