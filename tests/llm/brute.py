"""Plain versions of the operators, for small inputs."""

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_components(rows, percent=85):
    """doc_id -> component of [(doc_id, text)]."""
    sets = [(i, shingles(t)) for i, t in rows]
    uf = Sets()
    for n, (i, a) in enumerate(sets):
        uf.find(i)
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                uf.join(i, j)
    return {i: uf.find(i) for i, _ in rows}


RULES = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12, 2),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0), ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
         ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 1, 0),
         ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 1, 0))


def secret_spans(text, rules=RULES):
    out = []
    for n, (kind, pat, least, group) in enumerate(rules):
        out += [(m.start(), n, m.end(), kind) for m in pat.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def redacted(text):
    out, at = [], 0
    for start, _, end, kind in secret_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + (text or "")[at:]


def best_fit(lengths, size):
    """Sorted rooms left by best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def multiset(rows):
    return Counter(map(repr, rows))
