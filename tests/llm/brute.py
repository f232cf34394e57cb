"""Plain definitions that the operators are held against."""

import hashlib
import re
import string
from collections import Counter

WORD = re.compile("[^ \t-\r]+")


def words(text):
    return WORD.findall(text or "")


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    found = {k: [m for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in rules.items()}
    spans = [f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms]
    return [len(ms) for ms in found.values()], digest(spans), spans


def secrets(text):
    text = text or ""
    keyword = "(" + "|".join(
        "".join(f"[{c}{c.upper()}]" if c in string.ascii_lowercase else c for c in w)
        for w in ("password", "passwd", "secret", "token")
    ) + "|[aA][pP][iI]_?[kK][eE][yY])"
    rules = {
        "assign": (keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    found = {k: [m for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in rules.items()}
    order = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, ms) in enumerate(found.items()) for m in ms)
    return [len(ms) for ms in found.values()], digest([x[2] for x in order]), [x[2] for x in order]


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + j for i, g in enumerate(windows) if many[g] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )
