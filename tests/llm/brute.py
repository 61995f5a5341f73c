"""Plain versions of the operators, for small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def order(i):
    return -(2**63) if i is None else i


def dedup_lines(rows, least=10):
    """rows: (id, text). Per row: n_lines, n_dropped, kept text."""
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = ascii_lower(line.strip(BLANK))
            if len(k) >= least:
                first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(ascii_lower(x.strip(BLANK)), order(i)) >= order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def cut_windows(rows, size=20):
    first = {}
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        w = WORD.findall(t or "")
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            first[k] = min(first.get(k, (order(i), a)), (order(i), a))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < (order(i), a):
                gone.update(range(a, a + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, n=5):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}


def near_duplicates(rows):
    """Per row: n_shingles, component id."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for n, s in enumerate(sets):
        for x in s:
            holders[x].add(n)
    for pair in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        a, b = (sets[k] for k in pair)
        if 100 * len(a & b) >= 75 * len(a | b):
            parent[root(pair[0])] = root(pair[1])
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root(n)] = min(least.get(root(n), order(i)), order(i))
    return [(i, len(sets[n]), least[root(n)]) for n, (i, _) in enumerate(rows)]


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {a + k for a, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines))


def corpus(seed=1, n=60, vocabulary=400):
    """Documents with copies, near copies, shared lines and passages, odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßÉ漢") for _ in range(rng.randrange(1, 9))) for _ in range(vocabulary)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = say(60), "Common Line " + say(6)
    texts = []
    for _ in range(n):
        kind = rng.randrange(8)
        if texts and kind == 0:
            text = rng.choice(texts)
        elif texts and kind == 1:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        else:
            text = say(rng.choice([0, 1, 3, 4, 5, 30, 90, 200]))
        if rng.random() < 0.3:
            text += " " + passage + " " + say(5)
        if rng.random() < 0.4:
            text = rng.choice([line, line.upper(), "\t" + line + "  "]) + "\n" + text + "\n" + line
        texts.append(text)
    texts += [None, "", " \n\t ", "A", "a"]
    return [(k * 3, t) for k, t in enumerate(texts)]
