"""Plain Python versions of the operators' rules, to hold small results against."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

UPPER = {i: i + 32 for i in range(65, 91)}
SPACE = " \t\n\x0b\f\r"


def lower(text: str) -> str:
    return text.translate(UPPER)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs, min_chars=20, min_documents=3):
    """[(doc, text)] -> [(doc, n_lines, n_dropped, kept text)]."""
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(SPACE))
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        stay = [
            x for x in lines
            if len(holders.get(key(x), ())) < min_documents or doc == max((d for d in holders[key(x)] if d is not None))]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def hits(docs, items, window=13):
    """[(doc, text)], [(item, text)] -> [(doc, n_words, n_hit, sorted items)]."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i : i + size]))
                if got:
                    found |= got
                    hit |= set(range(i, i + size))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def near(docs, size, percent=80):
    """[(doc, text)] -> {doc: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, size) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[min(a, b), max(a, b)] += 1
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def check_packing(docs, rows, ids_of, capacity):
    """Assert that ``rows`` (doc, piece, start, length, crc, sequence, offset) pack the documents without gap or loss."""
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for doc, text in docs:
        ids = [*(ids_of(text) if text else []), 0]
        got = sorted(by_doc[doc], key=lambda r: r[1])
        assert [r[1] for r in got] == list(range(len(got)))
        at = 0
        for r in got:
            assert r[2] == at
            assert r[4] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r[3]]))
            at += r[3]
        assert at == len(ids)
        assert all(r[3] == capacity for r in got[1:]) and (len(got) == 1 or len(ids) > capacity)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r[5]].append((r[6], r[3]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def passages(rows, window):
    """(doc, words, removed words, kept text): words inside windows that also start in a smaller document."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, words in split:
        for i in range(len(words) - window + 1 if d is not None else 0):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1 if d is not None else 0):
            if first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out


def url_shape(path):
    typed = [
        re.sub(r"\d+", "{n}", re.sub(r"\b(?=[0-9a-f-]*\d)[0-9a-f]{8,}(-[0-9a-f]{4,})*\b", "{id}", s, flags=re.I | re.A), flags=re.A)
        for s in path.split("/") if s]
    runs = [(s, len(list(run))) for s, run in itertools.groupby(typed)]
    return tuple(s + "+" * (n > 1) for s, n in runs) + (("/",) if path.endswith("/") else ())


def _same_share(b, k, others_b, others_k, chance):
    slack = math.sqrt(math.log(2 / chance) / 2) * (k ** -0.5 + others_k ** -0.5) if k and others_k else 0
    return not k or not others_k or abs(b / k - others_b / others_k) <= slack


def url_rejected(rows, chance=0.05, purity=0.8):
    """[(host, path, blocked or None)] -> {(host, shape)} whose template is rejected; a node's children are compared one by one."""
    counts = defaultdict(lambda: [0, 0, 0])
    for host, path, blocked in rows:
        c = counts[host, url_shape(path)]
        c[0], c[1], c[2] = c[0] + 1, c[1] + (blocked is not None), c[2] + bool(blocked)
    template, nodes, level = {}, defaultdict(list), 0
    for host, shape in counts:
        nodes[host, ""].append(shape)
    while nodes:
        below = defaultdict(list)
        for (host, name), shapes in nodes.items():
            children = defaultdict(list)
            for s in shapes:
                if len(shapes) == 1 or len(s) <= level:
                    template[host, s] = "/".join([name, *s[level:]])
                else:
                    children[s[level]].append(s)
            following, labels, groups = {}, {}, defaultdict(list)
            for child, under in children.items():
                following[child] = Counter()
                for s in under:
                    following[child][s[level + 1] if len(s) > level + 1 else ""] += counts[host, s][0]
                labels[child] = [sum(counts[host, s][i] for s in under) for i in (1, 2)]
                groups[min(following[child], key=lambda x: (-following[child][x], x))].append(child)
            for usual, group in groups.items():
                for child in group:
                    own, others = following[child], Counter()
                    for c in group:
                        if c != child:
                            others.update(following[c])
                    called = child
                    if others:
                        m, n = own.total(), others.total()
                        distance = math.sqrt(sum((own[x] / m - others[x] / n) ** 2 for x in own | others))
                        k, b = (sum(labels[c][i] for c in group if c != child) for i in (0, 1))
                        if distance <= (1 + math.sqrt(2 * math.log(1 / chance))) * (m ** -0.5 + n ** -0.5) and _same_share(
                                labels[child][1], labels[child][0], b, k, chance):
                            called = "*?" + usual
                    below[host, f"{name}/{called}"] += children[child]
        nodes, level = below, level + 1
    sums = defaultdict(lambda: [0, 0])
    for (host, shape), name in template.items():
        sums[host, name][0] += counts[host, shape][1]
        sums[host, name][1] += counts[host, shape][2]
    return {(h, s) for (h, s), name in template.items() if (sums[h, name][1] + 1) / (sums[h, name][0] + 2) >= purity}
