"""The contracts of the corpus queries in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import xxhash

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def fold(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOW))


def contamination(docs: list[tuple], items: list[tuple]) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = []
    for item, text in items:
        own = words(text)
        windows += [(str(item), own[i : i + 13]) for i in range(max(1, len(own) - 12)) if own]
    by_first: dict[str, list] = {}
    for item, w in windows:
        by_first.setdefault(w[0], []).append((item, w))
    out = {}
    for doc_id, text in docs:
        own, hit, seen = words(text), set(), set()
        for i, first in enumerate(own):
            for item, w in by_first.get(first, ()):
                if own[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    seen.add(item)
        out[doc_id] = (len(own), len(hit), len(seen), sha(",".join(sorted(seen))), len(hit) > 0 and 20 * len(hit) >= len(own))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    found, kinds = [], list(_PATTERNS)
    for kind, pattern in _PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))


def fingerprint(text: str | None) -> int:
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict, radius: int = 2) -> dict:
    """id -> smallest id reachable over prints that differ in at most `radius` bits."""
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        after = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (after == label).all():
            return {i: ids[k] for i, k in zip(ids, label.tolist(), strict=True)}
        label = after


def equal_texts(docs: list[tuple]) -> dict:
    """doc_id -> (keep_id, group_size, kept, text_sha256), the largest doc_id staying."""
    by: dict[str, list] = {}
    for doc_id, text in docs:
        by.setdefault(text or "", []).append(doc_id)
    return {i: (max(ids), len(ids), i == max(ids), sha(text)) for text, ids in by.items() for i in ids}


def turns_cost(opened: list[int]) -> int | None:
    """Empty turns that make these turns (1 system, 2 user, 3 assistant) legal; None if nothing does."""
    before, count = 0, 0
    for role in opened:
        if role == 1:
            if before:
                return None
        elif role == 2:
            count += before == 2
        else:
            count += before != 2
        before = role
    return count + {1: 2, 2: 1, 3: 0}[before]


def least_cost(roles: list[int], relabel: dict, insert: int, merge: int) -> int:
    """Over every choice of a role and of opening or joining a turn for each row."""
    best = 1 << 30
    for target in itertools.product((1, 2, 3), repeat=len(roles)):
        price = sum(0 if a == b else relabel[a, b] for a, b in zip(roles, target, strict=True))
        for joins in itertools.product((False, True), repeat=len(roles) - 1):
            joined = [False, *joins]
            if any(j and target[k] != target[k - 1] for k, j in enumerate(joined)):
                continue
            empty = turns_cost([t for t, j in zip(target, joined, strict=True) if not j])
            if empty is not None:
                best = min(best, price + insert * empty + merge * sum(joined))
    return best
