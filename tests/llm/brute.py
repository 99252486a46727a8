"""Slow and plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

WHITE = " \t\n\x0b\x0c\r"


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(f"[^{WHITE}]+", text or "")


def byte_bpe() -> tiktoken.Encoding:
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_bpe() -> Tokenizer:
    out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out.encode_special_tokens = True
    return out


def word_ids(tokenizer: Tokenizer, text: str | None) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def shingles(text: str | None) -> frozenset:
    said = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not said:
        return frozenset()
    return frozenset(tuple(said[i : i + 5]) for i in range(max(1, len(said) - 4)))


def near_components(docs: list[tuple[int, str | None]], percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of its set, component)."""
    sets = {d: shingles(t) for d, t in docs}
    holders: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        common: dict[int, int] = {}
        for x in s:
            for other in holders[x]:
                if other < d:
                    common[other] = common.get(other, 0) + 1
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = find(d), find(other)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def without_repeats(docs: list[tuple[int, str | None]], n: int = 13) -> dict[int, tuple[int, list[str]]]:
    """doc_id -> (number of words, kept words)."""
    first: dict[tuple, int] = {}
    said = {d: words(t) for d, t in docs}
    for d, w in said.items():
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            first[x] = min(d, first.get(x, d))
    out = {}
    for d, w in said.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out[d] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out


_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    out = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, e, ("assign", "access", "hex")[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def best(vectors: list[tuple[int, list[int]]], queries: list[int], k: int) -> list[tuple[int, int, int, int]]:
    by = dict(vectors)
    out = []
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(by[q], v, strict=True)), i) for i, v in vectors if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


def all_spans(text: str, patterns: dict, reach: int) -> list[tuple[int, int, str]]:
    """Base spans, and weak ones that the pairs of all parts link. patterns: of weak kinds, (kind, pattern, group)."""
    base = base_spans(text)
    weak = [(*m.span(group), kind) for kind, pattern, group in patterns for m in pattern.finditer(text)]
    ids_there = any(k in ("access", "weak_id") for _, _, k in base + weak)
    weak = [w for w in weak if not any(s < w[1] and w[0] < e for s, e, _ in base)]
    blanks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda at: sum(b <= at for b in blanks)
    every = base + weak

    def beside(w: tuple, kinds: tuple) -> bool:
        return any(k in kinds and (s, e) != w[:2] and scope(s) == scope(w[0]) and s <= w[1] + reach and e >= w[0] - reach for s, e, k in every)

    out = list(base)
    for w in set(weak):
        by_id, by_secret = beside(w, ("access", "weak_id")), beside(w, ("assign", "hex", "weak_secret"))
        if ids_there and {"weak_id": by_secret, "weak_secret": by_id, "endpoint": by_id and by_secret}[w[2]]:
            out.append(w)
    order = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
    return sorted(out, key=lambda x: (x[0], order.index(x[2]), x[1]))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """Each run of characters in spans, joined where spans overlap, as one mark."""
    inside = [False] * len(text)
    starts = set()
    for s, e, _ in spans:
        if not inside[s]:
            starts.add(s)
        inside[s:e] = [True] * (e - s)
    out, i = [], 0
    while i < len(text):
        if i in starts:
            out.append(mark)
        if not inside[i]:
            out.append(text[i])
        i += 1
    return "".join(out)
