"""Plain Python versions of the operators, and small tables that hold the cases they must survive."""

from __future__ import annotations

import collections
import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Names that operators use inside, as columns of the caller.
EXTRA = ("n", "_id", "_text", "doc", "bucket", "key", "set_hash", "size", "sid", "start", "measures", "step0", "ids", "spans", "shard", "slot", "copy", "text_hash")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in EXTRA],
    ]
)


def words_of(text):
    return WORD.findall(text or "")


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) as documents with clashing extra columns."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edge_rows(long_words=30_000):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[50] = "changed"
    passage = prose(rng, 60)
    return [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (3, " ".join(near), None, "b"),
        (4, None, "en", "a"),
        (5, "", "en", None),
        (6, " \n\t ", "de", "a"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (7, prose(rng, long_words), "en", "a"),
        (8, "Only three words", "en", "c"),
        (8, "Only three words", "en", "c"),
        (8, "only THREE words", "en", "c"),
        (9, prose(rng, 40) + " " + passage + "\n" + prose(rng, 10), "fr", "é"),
        (10, passage + " " + prose(rng, 30), "fr", "z"),
        (11, "w " * 3000, "en", "a"),
        (12, "éè\U0001f600 naïve café " * 20, "fr", None),
    ]


def shingles(text, k):
    w = words_of((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])


def components(rows, k, percent):
    """Component per row of (id, text); null for rows without an id."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, len(sets[x]), None if i is None else least[find(x)]) for x, (i, _) in enumerate(rows)]


def without_repeats(rows, k):
    """(id, n_words, n_removed, kept) per row of (id, text)."""
    first = {}
    for i, t in rows:
        w = words_of(t)
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words_of(text)
    seen = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    covered = {j + d for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Target per source, by resharing what is over the caps until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed, free = share * sum(sizes.values()), {}, set(names)
    while free:
        rest, whole = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / whole > cap * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / whole for s in free}
        for s in over:
            fixed[s] = cap * sizes[s]
            free.discard(s)
    return fixed


def plain_order(rows):
    """Rows in an order that nulls do not disturb."""
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])
