"""Plain Python counterparts of the operators, over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def covered(sequences, window):
    """For each sequence, in order, which units lie in a window that stands earlier."""
    seen, out = set(), []
    for units in sequences:
        gone = bytearray(len(units))
        for i in range(len(units) - window + 1):
            key = tuple(units[i : i + window])
            if key in seen:
                gone[i : i + window] = b"\x01" * window
            seen.add(key)
        out.append(gone)
    return out


def shingles(text, n, lower=False):
    w = words((text or "").translate(LOWER) if lower else text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, percent=85, n=3):
    sets = {i: shingles(t, n, lower=True) for i, t in docs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def base_places(text, phrases):
    lowered = (text or "").translate(LOWER)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in phrases.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), found


def repeated_words(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)})
