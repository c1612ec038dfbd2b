"""Small tables with the odd cases: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

_WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper kapok larch maple neem oak pine quince rowan".split()


def prose(rng, n):
    return " ".join(rng.choice(_WORDS) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))


def documents(seed=5):
    """(doc_id, text), with ids of their own."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [None, "", "  \n\n ", "Ähre Größe", "one two three", "a " * 400, "ab" * 300]
    for i in range(40):
        lines = [prose(rng, rng.randrange(4, 30)) for _ in range(rng.randrange(1, 9))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        if i % 5 == 0:
            lines += ["shared first line", "", "shared second line", "shared third line " + "é" * (i % 2)]
        texts.append("\n".join(lines))
    base = prose(rng, 150).split()
    for i in range(12):  # near copies
        copy = list(base)
        copy[(i * 11) % 150] = f"changed{i}"
        texts.append(" ".join(copy))
    texts += [texts[20], texts[20].upper(), texts[21], texts[21] + " end", prose(rng, 6000)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def items(docs, seed=6):
    """(item_id, text): passages of documents, short items, one without words, repeats."""
    rng = random.Random(seed)
    long = [t for _, t in docs if t and len(t.split()) > 40]
    out = [(f"i{k}", " ".join(rng.choice(long).split()[k:k + 9 + k])) for k in range(8)]
    return out + [("short", "one TWO three"), ("single", "größe"), ("none", " .,"), ("null", None), out[3], ("i0", "quite other words")]


def frame(spark, docs):
    """The documents with extra columns whose names the operators use themselves."""
    rows = [(d, t, "x", 1, 2, "y") for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_words int, start int, _p string").repartition(3)
