"""Plain versions of the digests, to hold the operators against."""

import hashlib
import re

PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}
SECRETS = {
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text, rules):
    found = []
    for rank, (kind, (pattern, good)) in enumerate(rules.items()):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m)]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def base_sha256(text, rules):
    return hashlib.sha256(",".join(base(text, rules)).encode()).hexdigest()
