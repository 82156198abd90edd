"""Plain versions of the operators, one row at a time."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def jump(key: int, shards: int) -> int:
    key, at, following = key & (2**64 - 1), -1, 0
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        following = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def fingerprint(text: str | None, width: int = 3) -> int:
    words = [w for w in re.split(r"[ \t-\r]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, linked) -> list[int]:
    """The lowest index of each index's component; ``linked(i)`` are the indices linked with i."""
    low = list(range(n))

    def find(x: int) -> int:
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for i in range(n):
        for j in linked(i):
            a, b = find(i), find(int(j))
            low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return total % 10 == 0


def personal_data(text: str) -> list[tuple[str, int, int]]:
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group(0).split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m.group(0))
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group(0))) <= 15:
            found.append(("phone", *m.span()))
    return found


def secrets(text: str) -> list[tuple[str, int, int]]:
    found = []
    rule = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(rule, text, re.A):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m.group(0)) >= 20:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group(0)) >= 24:
            found.append((m.start(), 2, "hex", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def battery(token: str) -> tuple[int, float | None]:
    """Length without padding, and the sum of squares of the three statistics (None if a test rejects)."""
    bare = token.replace("-", "+").replace("_", "/").rstrip("=")
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    if bare.isdigit():
        alphabet = "0123456789"
    elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare):
        alphabet, bare = "0123456789abcdef", bare.lower()
    else:
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if re.fullmatch("[A-Z2-7]+", bare) else b64
    a, n, x = len(alphabet), len(bare), np.array([alphabet.index(c) for c in bare], float)
    chi = sum(bare.count(c) ** 2 for c in set(bare)) * a / n - n
    chi = max(0.0, (chi - (a - 1)) / np.sqrt(2 * (a - 1) * (n - 1) / n))
    high = x >= a / 2
    both = 2 * high.sum() * (n - high.sum())
    variance = both * (both - n) / (n * n * (n - 1))
    runs = ((high[1:] != high[:-1]).sum() - both / n) / np.sqrt(variance) if variance > 0 else 99.0
    d = x - x.mean()
    serial = ((d[1:] @ d[:-1]) / (d @ d) + 1 / n) * np.sqrt(n) if d @ d > 0 else 99.0
    total = chi**2 + runs**2 + serial**2
    return n, total if max(chi, abs(runs), abs(serial)) < 3.3 and total < 16.3 else None


def random_tokens(texts: list[str], rate: float = 0.05) -> set[str]:
    """Tokens outside base spans that are found at the false discovery rate, p-values ranked one by one."""
    decoys: dict[str, tuple[int, float]] = {}
    others: dict[str, tuple[int, float]] = {}
    for text in texts:
        base = secrets(text)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", text):
            if any(s < m.end() and m.start() < e for _, s, e in base):
                continue
            n, total = battery(m.group())
            word = re.fullmatch("[A-Z]?[a-z]+|[A-Z]+", m.group())
            (decoys if word else others)[m.group()] = min(n // 8, 16), np.inf if total is None else np.floor(total * 64)
    found = set()
    for group in {g for g, _ in others.values()}:
        words = [x for g, x in decoys.values() if g <= group]
        own = {t: x for t, (g, x) in others.items() if g == group}
        ps = {t: (1 + sum(w <= x for w in words)) / (1 + len(words)) for t, x in own.items() if x < np.inf}
        bound = max((own[t] for t, p in ps.items() if p * len(own) <= rate * sum(own[u] <= own[t] for u in ps)), default=-1)
        found |= {t for t in ps if own[t] <= bound}
    return found


def spans_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans) -> str:
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def overlap(text: str | None, item: str) -> int:
    """Words of the item in stretches of at least 80 % equal words, over all diagonals that a mask hits.

    A stretch begins and ends with an equal word. It counts if it has 20 words or 80 % of the item's, or if its
    equal words, less four times the others, come to six.
    """
    a, b = words(text), words(item)
    enough = min(-(-len(b) * 4 // 5), 20)
    covered: set[int] = set()
    for diagonal in range(-len(b), len(a) + 1):
        equal = [i for i in range(len(b)) if 0 <= i + diagonal < len(a) and a[i + diagonal] == b[i]]
        held = set(equal)
        hit = any(
            all(i + k in held for k, c in enumerate(mask) if c == "1")
            for mask in ("11111", "1101011", "11001101")
            for i in range(max(0, -diagonal), min(len(b), len(a) - diagonal) - len(mask) + 1)
        )
        for m, first in enumerate(equal) if hit else ():
            for n in range(m, len(equal)):
                length, same = equal[n] - first + 1, n - m + 1
                if same - 4 * (length - same) >= 6 or (5 * same >= 4 * length and length >= enough):
                    covered.update(range(first, equal[n] + 1))
    return len(covered)


def unit(rows) -> np.ndarray:
    rows = np.asarray(rows, float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
