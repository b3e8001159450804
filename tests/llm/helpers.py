"""Small tables with all that may go wrong, and plain versions of the operators."""

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, id string, part int,"
        " row string, line int, start int, size int, words string, slot int, h long, g string")


def spaced(text):
    return SPACED.findall((text or "").translate(LOWER))


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def documents(spark, rows):
    """(doc_id, text[, source]) with columns whose names clash with inner ones."""
    full = []
    for row in rows:
        doc_id, text, source = (*row, "s")[:3]
        full.append((doc_id, text, "en", source, len(text or ""), "x", 1, "r", 2, 3, 4, "w", 5, 6, "g"))
    return spark.createDataFrame(full, DOCS)


def prose(seed, n):
    """n words, mostly different ones."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


def odd_rows():
    """Null ids and texts, empty and blank texts, ties, repeated rows, a very long text."""
    return [
        (1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, " \t\n "), (None, prose(1, 60)),
        (None, None), (6, prose(2, 80)), (6, prose(2, 80)), (7, prose(3, 30000)), (8, "One"),
        (9, "one"), (10, "a b"), (11, "Ä É ñ 漢字 🙂 x"), (12, prose(4, 50) + "\n" + prose(1, 60)),
    ]


def components(nodes, links):
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_groups(rows, size, percent=80):
    """{doc_id: (n_shingles, component)} of rows with an id, by comparing all pairs."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        w = spaced(text)
        s = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        sets[doc_id].append(s)
    ids = [i for i in sets if i is not None]
    links = []
    for a in ids:
        for b in ids:
            if a < b and any(
                    x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                links.append((a, b))
    found = components(ids, links)
    return {i: (len(sets[i][0]), found[i]) for i in ids}


def repeated_lines(rows, min_words=1, percent=80):
    """{doc_id: numbers of lines similar to an earlier one}; rows come in order."""
    seen, out = [], {}
    for doc_id, text in rows:
        gone = []
        for k, line in enumerate((text or "").split("\n")):
            words = spaced(line)
            if len(words) < min_words:
                continue
            own = set(words)
            if any(100 * len(own & s) >= percent * len(own | s) for s in seen):
                gone.append(k)
            seen.append(own)
        out[doc_id] = gone
    return out
