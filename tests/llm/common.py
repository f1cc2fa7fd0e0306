"""Small tables with the awkward cases, and plain definitions to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, alphabet: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(alphabet):03d}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def sample_texts() -> list[str | None]:
    """Nulls, blanks, one word, ties, copies, near copies, shared passages, repetition and a very long text."""
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    passage = prose(2, 120)
    return [None, "", " \t\n ", "single", "two words", base, base, " ".join(near), base.upper(), prose(3, 90) + " " + passage,
            passage + "\n" + prose(4, 80), "For " * 300, "É x\x1cy naïve space  doubled\n\nline line", prose(5, 12000),
            prose(6, 60), prose(6, 60), "a | b | c | " * 40, prose(7, 4), prose(8, 5), "x" * 5000]


def documents(spark, texts=None):
    texts = sample_texts() if texts is None else texts
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def clashing(df):
    """The same rows with columns whose names operators use inside or return."""
    from pyspark.sql import functions as F

    names = ("kept", "n_words", "score", "component_id", "length", "part", "rank", "spans", "n_private", "a", "b", "id", "key", "llr", "weights")
    return df.withColumns({c: F.lit("taken") for c in names})


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(sets: dict, percent=85) -> dict:
    """The least id reachable over links of the stated similarity, by comparing all pairs."""
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                lead[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}
