"""Small corpora that tests share, and brute-force helpers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, rid string"
ODD_TEXTS = [None, "", "   \n\t ", "one", "ONE two", "one two three", "İstanbul ŉ ǰ \x1c x", "漢字 仮名 🙂 a b", "a" * 9000, "w " * 5000, "é" * 50 + "\x00 tail", "same words here", "same words here", "퟿ end"]


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Null ids, repeated rows, ties, null columns, empty and long texts."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "web", None, i, 0.5, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id at all here", None, None, 3, None, None, None), (None, None, None, None, None, None, None, None), rows[3], rows[3]]
    return rows


def odd(spark):
    """A table whose extra columns clash with names the operators use."""
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_copies(seed: int = 4, families: int = 12):
    """[(doc_id, text)]: base texts, exact copies and copies with one word changed, with strangers between."""
    rng, rows, family = random.Random(seed), [], {}
    for f in range(families):
        base = prose(rng, 120).split()
        for k in range(4):
            words = list(base)
            if k > 1:
                words[rng.randrange(len(words))] = f"changed{k}"
            family[len(rows)] = f
            rows.append((len(rows), " ".join(words)))
        family[len(rows)] = -1 - f
        rows.append((len(rows), prose(rng, 120)))
    return rows, family


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
