"""Plain versions of the operators, over lists of (doc_id, text), that the tests compare with."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def held_out(doc_id: int, parts: int, rest: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % parts == rest


def removed(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple]:
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256; ids are distinct."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        own = {raw[i : i + length] for i in range(len(raw) - length + 1)}
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
        seen |= own
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        out[doc_id] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text: str | None, size: int = 4) -> int:
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict[int, int], bits: int = 4) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits).tolist():
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeat.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), len(words) < 20 or 100 * len(repeat) > 30 * len(words)


def kept(text: str | None) -> bool:
    """Whether the latest policy of the quality rules keeps a text."""
    text = text or ""
    words = WORD.findall(text)
    n, chars, symbols, repeated, _, base_failed = quality(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    capitals, small = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    shouted, stuttered = sum(w.count("!") > 1 for w in words), sum(a == b for a, b in zip(words, words[1:], strict=False))
    failed = (
        base_failed, 10 * symbols > 3 * n, 10 * shouted > 3 * n, capitals > 2 * small and capitals > 40, len(lines) > 3 and 2 * repeated > len(lines),
        n > 0 and not 2 * n <= chars <= 25 * n, 2 * stuttered > n, n == 0,
    )
    return not any(failed)


def base_scores(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id -> held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = {i: [*WORD.findall((t or "").translate(ASCII_LOWER)), None] for i, t in docs}
    counts = Counter(t for i, own in tokens.items() if not held_out(i, 7, 2) for t in own)
    n, v = sum(counts.values()), len(counts)
    return {i: (held_out(i, 7, 2), len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in own)) for i, own in tokens.items()}


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_dedup(docs: list[tuple[int, str | None]], least: int = 16) -> dict[int, tuple]:
    """doc_id -> kept text, n_lines, n_removed, n_near."""
    first: dict[str, None] = {}
    out = {}
    for doc_id, text in sorted(docs):
        kept, n, gone, near = [], 0, 0, 0
        for line in (text or "").split("\n"):
            if not WORD.search(line):
                kept.append(line)
                continue
            n += 1
            if line in first:
                gone += 1
                continue
            if any(max(len(line), len(x)) >= least and one_edit(line, x) for x in first):
                gone, near = gone + 1, near + 1
            else:
                kept.append(line)
            first[line] = None
        out[doc_id] = ("\n".join(kept), n, gone, near)
    return out


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = 10) -> dict[int, tuple]:
    """doc_id -> n_words, n_hit, n_items, items_sha256, contaminated."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(ASCII_LOWER))
    phrases: dict[tuple, set[str]] = {}
    for name, text in items:
        own = cut(text)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            phrases.setdefault(tuple(own[i : i + n]), set()).add(name)
    lengths = {len(p) for p in phrases}
    out = {}
    for doc_id, text in docs:
        own, hit, names = cut(text), set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                if found := phrases.get(tuple(own[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out[doc_id] = (len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out
