"""Small tables and plain versions of the operators."""

import random
import re
from collections import Counter

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows):
    """Documents from (doc_id, text[, source[, lang]]), with extra columns named like inner ones."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x") for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def bag(text, width=5):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def jaccard(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 0.0


def classes(ids, links):
    """Smallest id reachable from each id."""
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def share(sizes, weights, budget, cap=2):
    """Targets by weight, each at most ``cap`` times its size; the excess goes to the others by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], budget
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        for i in over or open_:
            out[i] = float(cap * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out
