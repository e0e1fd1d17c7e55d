"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re
from collections import Counter

import numpy as np
import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    words = WORD.findall(lower(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(docs):
    """{doc_id: (set size, component)} of (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(docs, width=400):
    """Spans and what is left of each text, in the order of ``docs``."""
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, np.int64)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        flag = np.cumsum(gone)[: len(b)] > 0
        runs = int((flag & ~np.concatenate(([False], flag[:-1]))).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~flag].tobytes()
        whole, start = "", 0
        for char in b.decode():  # a character stays if all its bytes do
            size = len(char.encode())
            whole += "" if flag[start : start + size].any() else char
            start += size
        out.append((len(b), int(flag.sum()), runs, hashlib.sha256(kept).hexdigest(), whole))
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if seen[words[i], words[i + 1], words[i + 2]] > 1 for j in range(3)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), n < 50 or 100 * len(covered) > 50 * n


def judge(rows, quality):
    """Verdicts of (lang, source, text) rows by the estimate of each group, with numpy on whole groups."""
    stats = [statistics(t) for _, _, t in rows]
    ok = [i for i, s in enumerate(stats) if not s[5]]
    fine, coarse = Counter((rows[i][0], rows[i][1]) for i in ok), Counter(rows[i][0] for i in ok)
    group = {}
    for i in ok:
        lang, source, _ = rows[i]
        key = (lang, source) if fine[lang, source] >= quality.LEAST_GROUP else (lang,) if coarse[lang] >= quality.LEAST_GROUP else ()
        group.setdefault(key, []).append(i)
    kept = [False] * len(rows)
    floor = np.diag((np.array(quality.FLOOR) * quality.GRID) ** 2)
    half_up = lambda x: np.floor(x + 0.5)

    def vectors(members):
        n, chars, symbols, lines, again = (np.array([stats[i][k] for i in members], float) for k in range(5))
        return half_up(np.stack((np.log1p(n), chars / n, np.sqrt(symbols / n), np.log1p(lines), np.sqrt(again / n)), 1) * quality.GRID)

    for key, members in group.items():
        x = vectors([i for i in ok if rows[i][: len(key)] == key])  # an estimate stands for its whole language, or all texts
        middle = np.median(x, 0)
        spread = np.maximum((1.4826 * np.median(np.abs(x - middle), 0)) ** 2, np.diag(floor)) + 1.0
        best = None
        for first in quality.STARTS:
            mean, inverse, share, was = middle, np.diag(1 / spread), first, None
            for step in range(quality.STEPS + 1):
                far = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
                level = np.floor(np.log2(far + 1e-3) * quality.CLASSES_PER_DOUBLING)
                last = np.sort(level)[int(np.ceil(share * len(x))) - 1]
                near = level <= last
                if was is not None and (near == was).all() or step == quality.STEPS:
                    break
                mean, cov, was, share = x[near].mean(0), np.cov(x[near].T, bias=True) * quality.consistency(), near, quality.SUBSET
                cov[np.diag_indices(5)] = np.maximum(np.diag(cov), np.diag(floor)) + 1.0
                inverse = np.linalg.inv(cov)
            if best is None or np.linalg.det(cov) < best[0] * (1 - 1e-9):
                best = np.linalg.det(cov), mean, inverse
        _, mean, inverse = best
        x = vectors(members)
        far = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
        for i, good in zip(members, far <= quality.chi_square_quantile(quality.QUANTILE, quality.P), strict=True):
            kept[i] = bool(good)
    return stats, kept


def merkle(text):
    """The root, the paragraphs' digests and the set of leaf digests of a text's tree."""
    from findling.llm import merkle as m

    leaf_end = regex.compile("(?V1)" + m.LEAF_END)
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    leaves, flat, top = set(), [], []
    for section in regex.split("(?V1)" + m.SECTION_END, text):
        inner = []
        for paragraph in regex.split("(?V1)" + m.PARAGRAPH_END, section):
            own = [digest([x]) for x in leaf_end.split(paragraph) if x]
            leaves.update(own)
            inner.append(digest(own))
        flat += inner
        top.append(digest(inner))
    return digest(top), flat, leaves
