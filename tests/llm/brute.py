"""Plain versions of the training-data problems, pair by pair, for small tables."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import regex

from versemill.llm.textform import reader_form


def words(text):
    return Counter(regex.findall(r"[\p{L}\p{N}\p{M}]+", (reader_form(text) or "").lower()))


def near(a: Counter, b: Counter) -> bool:
    na, nb = sum(a.values()), sum(b.values())
    return na >= 10 and nb >= 10 and sum((a & b).values()) * 10 >= 7 * max(na, nb)


def near_pairs(rows):
    """Pairs of keys of (key, text) rows; candidates share one of their words."""
    of = {k: words(t) for k, t in rows}
    of = {k: w for k, w in of.items() if sum(w.values()) >= 10}
    df = Counter(w for c in of.values() for w in c)
    by = defaultdict(list)
    for k, c in of.items():
        each = sorted(((df[w], w) for w in c.elements()))
        for _, w in each[: len(each) - -(-len(each) * 7 // 10) + 1]:
            by[w].append(k)
    seen = {p for ks in by.values() for p in combinations(sorted(set(ks)), 2)}
    return {p for p in seen if near(of[p[0]], of[p[1]])}


def components(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def same_look(rows):
    by = defaultdict(list)
    for k, t in rows:
        if t is not None and (form := reader_form(t)):
            by[form].append((k, t))
    return {(min(a, b), max(a, b)) for g in by.values() for (a, x), (b, y) in combinations(g, 2) if x != y and a != b}


def best(rows, trust, nobody):
    """rows: dicts of the material table."""
    groups = defaultdict(list)
    for r in rows:
        if r["text"] is not None:
            groups[unicodedata.normalize("NFC", r["text"]).lower().strip()].append(r)
    out = set()
    for g in groups.values():
        if len(g) < 2:
            continue

        def author(r):
            a = re.sub(r"[()\[\]]", "", (r["author"] or "").strip().lower()).strip()
            return bool(a) and a not in nobody and any(c.isalnum() for c in a)

        def url(r):
            return bool(re.match(r"(?i)https?://[\w\[]", (r["url"] or "").strip()))

        def refs(r):
            return any((x["source_id"] or "").strip() or (x["url"] or "").strip() for x in r["source_refs"] or [])

        def rank(r):
            at = r["ingested_at"].timestamp() if r["ingested_at"] is not None else float("-inf")
            return (-trust.get(r["source_id"], -1), -at, r["rec_no"])

        def top(rs):
            return min(rs, key=rank)["rec_no"] if rs else 0

        b = min(g, key=lambda r: (-(author(r) + url(r) + refs(r)), *rank(r)))["rec_no"]
        out.add((min(r["rec_no"] for r in g), b, top([r for r in g if author(r)]), top([r for r in g if url(r)])))
    return out


def split_of(s):
    s = re.sub(r"\s", "", s or "").lower()
    return {"train": "train", "training": "train", "dev": "dev", "val": "dev", "validation": "dev", "test": "test"}.get(s)


def torn(rows, nothing):
    def name(v, prefix):
        v = re.sub(r"\s", "", v or "").lower().removeprefix(prefix)
        return None if v in nothing else v

    pairs, nodes = [], {}
    for r in rows:
        k = r["rec_no"]
        for tag, v in (("c", name(r["duplicate_cluster"], "cluster-")), ("w", name(r["work_id"], "fsoft:"))):
            if v is not None:
                pairs.append((k, nodes.setdefault((tag, v), k)))
    comp = components(pairs)
    groups = defaultdict(list)
    for r in rows:
        groups[comp.get(r["rec_no"], r["rec_no"])].append(r)
    return {(r["rec_no"], g) for g, rs in groups.items() if len({split_of(r["split"]) for r in rs} - {None}) > 1 for r in rs}


def span_pairs(rows, least=100):
    by = defaultdict(set)
    for k, t in rows:
        for i in range(len(t or "") - least + 1):
            by[t[i : i + least]].add(k)
    return {p for ks in by.values() if len(ks) > 1 for p in combinations(sorted(ks), 2)}
