"""Small tables with awkward rows, and brute-force forms of the operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __key long, row string, marks int"


def docs_frame(spark, texts, ids=None):
    """Documents with further columns whose names clash with inner ones."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if n % 5 == 4 else f"s{n % 3}", None if t is None else len(t), n, "x", n)
            for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = [x.translate(LOWER) for x in words(text)]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def union_find(items, links):
    parent = {i: i for i in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in items}
