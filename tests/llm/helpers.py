"""Plain versions of what the operators compute, for small inputs."""

import re
import string

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def shingles(text, k):
    w = spaced(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


DOCS = "doc_id long, text string"
#: Cases that every text operator must take: null id, null, empty and blank texts, a repeated row, a long text, odd signs.
ODD = [(None, "some text of a row without an id"), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "twice the same row here"), (9004, "twice the same row here"), (9005, "long " * 60_000), (9006, "Ünï \x00 © ﷽ 日本 \x85 +1 @ # 1.2.3"), (9007, "one")]


def clashing(df):
    """df with more columns, named like those that operators use within."""
    from pyspark.sql import functions as F

    for name in ("id", "_id", "key", "label", "n", "kept", "length", "sequence_id", "rule", "grade", "_row", "part", "b"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(name))
    return df
