"""Plain reference implementations for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict


def repeated_bytes(texts, length, first_stays=False):
    """Covered positions of every text, by looking at all strings of ``length`` bytes."""
    places = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for row, text in enumerate(data):
        for at in range(len(text) - length + 1):
            places[text[at : at + length]].append((row, at))
    gone = [set() for _ in data]
    for found in places.values():
        for row, at in found[int(first_stays) :] if len(found) > 1 else []:
            gone[row].update(range(at, at + length))
    return [sorted(g) for g in gone]


def shingle_set(text, k=5):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_components(texts, similarity=75):
    """Smallest reachable row of every text, over all pairs."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= similarity * (len(a) + len(sets[j]) - both):
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def joined_components(rows, similarity, k):
    """(doc_id, size, least reachable id) of every row; rows with one id are one document."""
    sets = [shingle_set(text, k) for _, text in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    def link(i, j):
        low, high = sorted((root(i), root(j)))
        label[high] = low

    seen = {}
    for i, one in enumerate(sets):
        if not one or rows[i][0] is None:
            continue
        link(i, seen.setdefault(rows[i][0], i))
        for j in range(i):
            both = len(one & sets[j]) if rows[j][0] is not None else 0
            if both and 100 * both >= similarity * (len(one) + len(sets[j]) - both):
                link(i, j)
    least = {}
    for i, (number, _) in enumerate(rows):
        if sets[i] and number is not None:
            least[root(i)] = min(least.get(root(i), number), number)
    return [
        (number, len(s), least[root(i)] if s and number is not None else number)
        for i, ((number, _), s) in enumerate(zip(rows, sets))
    ]


def collocations(rows, least, dominance=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting all n-grams."""
    counts, words_of = defaultdict(int), defaultdict(int)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lowered(text)):
            words = re.findall(r"[^ \t]+", piece)
            words_of[lang] += len(words)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    counts[lang, tuple(words[at : at + size])] += 1
    frequent = {key: f for key, f in counts.items() if f >= least}
    dropped = set()
    for (lang, words), f in frequent.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                if 100 * f >= dominance * counts[lang, words[at : at + size]]:
                    dropped.add((lang, words[at : at + size]))
    found = defaultdict(list)
    for (lang, words), a in frequent.items():
        if len(words) > 1 and (lang, words) not in dropped:
            score, _, l, r = min(
                (2000000 * a // (l + r), k, l, r)
                for k in range(1, len(words))
                for l, r in [(counts[lang, words[:k]], counts[lang, words[k:]])]
            )
            found[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return [
        (lang, rank, phrase.decode(), -a, l, r, words_of[lang], -score)
        for lang, phrases in found.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(phrases)[:top], 1)
    ]


def spelling(rows, factor=10):
    """(word, form, root, n, n_near, form_n) by trying all edits."""
    import zlib

    n = defaultdict(int)
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            mark = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    masked = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = {
        w: {v for i in range(len(w)) for v in masked[w[:i] + "\0" + w[i + 1 :]]} - {w}
        for w in words
    }
    for w in words:
        for v in {w[:i] + w[i + 1 :] for i in range(len(w))} & words.keys():
            near[w].add(v)
            near[v].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [
        (w, form[w], root(w), c, len(near[w]), words[form[w]] if form[w] else None)
        for w, c in words.items()
    ]


def contamination(docs, items, hashed, masks, similarity=75, window=32):
    """Pairs (doc, item) with a window on some diagonal that matches well enough: those in
    which a mask matches there, and all of them."""
    import numpy as np

    seeded, everywhere = set(), set()
    wanted = {i: np.array(hashed(text)) for i, text in items.items()}
    for doc, text in docs.items():
        words = np.array(hashed(text))
        for item, other in wanted.items():
            size = min(window, len(other))
            if size < 5:
                continue
            # All places where the same word stands, by their diagonal.
            at, place = np.nonzero(words[:, None] == other[None, :])
            diagonals, counts = np.unique(at - place, return_counts=True)
            for diagonal in diagonals[100 * counts >= similarity * size].tolist():
                same = np.zeros(len(other), bool)
                same[place[at - place == diagonal]] = True
                sums = np.append(0, np.cumsum(same))
                first = np.flatnonzero(100 * (sums[size:] - sums[:-size]) >= similarity * size)
                if not len(first):
                    continue
                everywhere.add((doc, item))
                for mask in masks:
                    span = mask[-1] + 1
                    n = len(other) - span + 1
                    hit = np.flatnonzero(np.all([same[m : m + n] for m in mask], axis=0)) if n > 0 else []
                    if any(((hit >= f) & (hit + span <= f + size)).any() for f in first.tolist()
                           if len(hit)):
                        seeded.add((doc, item))
    return seeded, everywhere
