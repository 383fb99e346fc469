"""Documents for tests: every awkward case at once, and brute-force versions of small steps."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, `digest` string, spans int, topic string, score double, `a.b` int"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lamda", "mu", "nu", "xi", "omikron", "pi"]


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, shared lines, null and empty and very long texts, repeated rows, null ids, ties."""
    rng = random.Random(seed)
    line = "This very line is shared by many of the documents."
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(k, words(rng, rng.randrange(1, 150)), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None])) for k in range(40)]
    rows += [(100, base, "en", "src0"), (101, base, "en", "src0"), (102, " ".join(near), "en", "src0"), (103, base.upper(), "de", "src1")]
    rows += [(200 + k, f"{words(rng, 30)}\n  {line.upper() if k % 2 else line}\t\n{words(rng, 20)}", "en", "src2") for k in range(6)]
    rows += [(300, None, None, None), (301, "", "en", "src0"), (302, " \n\t", "en", None), (303, "one two", "de", "src1"), (304, "One  TWO", "de", "src1"), (305, "12 34 !?", "de", "src1")]
    rows += [(400, words(rng, 12_000), "en", "src0"), (401, "x" * 70_000, "en", "src0"), (402, "ä漢字 ελληνικά " * 300, "de", "src1")]
    rows += [(None, base, "en", "src0"), (None, None, None, None), (500, words(rng, 50), "en", "src0")]
    return [*rows, rows[-1], (500, "another text of the same id", "de", "src1")]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 1, "d", None, "t", 0.5, 3) for i, t, g, s in rows], SCHEMA)


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def shingles(text: str | None) -> frozenset:
    w = space_words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets: dict[int, list[frozenset]]) -> dict[int, list[int]]:
    """Of each row of each id: the smallest id that links reach, by comparing all pairs."""
    nodes = [(i, s) for i, own in sets.items() for s in own]
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(nodes):
        least[find(k)] = min(i, least.get(find(k), i))
    out: dict[int, list[int]] = {}
    for k, (i, _) in enumerate(nodes):
        out.setdefault(i, []).append(least[find(k)])
    return out


def line_dedup(rows: list[tuple[int | None, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple[int, int, str]]:
    """(lines, dropped, kept text) of each row."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: ascii_lower(line.strip(strip))
    held: dict[str, set[int]] = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def decontaminate(text: str | None, items: dict[str, str | None], width: int = 10) -> tuple[list[str], set[int], set[str]]:
    """Words, places of hit words, items found."""
    found = alnum_words(text)
    hit, owners = set(), set()
    for item, body in items.items():
        w = alnum_words(body)
        for window in {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else ():
            for k in range(len(found) - len(window) + 1):
                if tuple(found[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    owners.add(item)
    return found, hit, owners
