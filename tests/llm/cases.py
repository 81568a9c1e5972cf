"""Documents with every awkward case, and brute-force versions of the contracts."""

import hashlib
import random
import re

from docloom.llm.common import WORD_RX

SCHEMA = "doc_id long, text string, lang string, source string, id string, h string, words string, row long, label string"


def words(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(WORD_RX, t)


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))


def texts(seed=7):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    passage = prose(rng, 120)
    long = prose(rng, 9000)
    out = [None, "", " \t\n", "one", "One!", "é É ñ", "a b c d", *base]
    out += [base[3]] * 5 + [base[3].replace(" ", "  ")] * 2 + [base[4].upper(), base[4]]
    for k in range(6):
        w = base[10].split(" ") + base[11].split(" ")
        w[5 * k] = f"changed{k}"
        out.append(" ".join(w))
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(8)]
    out += [long, long + " end", "x" * 5000, "ab" * 3000]
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", "id", "h", "words", 1, "label") for i, t in enumerate(rows)]
    data += [(3, "one", "en", "s", "id", "h", "words", 1, "label")] * 2  # repeated rows
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()
