"""Plain single-process versions of the operators, for comparison."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def fingerprint(text):
    import xxhash
    words = WORDS.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits=4):
    """fps: {doc_id: fingerprint}; {doc_id: smallest id reachable}."""
    ids = sorted(fps)
    left, out = set(ids), {}
    for i in ids:
        if i not in left:
            continue
        left.discard(i)
        todo, out[i] = [i], i
        while todo:
            a = todo.pop()
            near = [b for b in left if bin(fps[a] ^ fps[b]).count("1") <= bits]
            left.difference_update(near)
            todo += near
            out.update((b, i) for b in near)
    return out


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def item_hits(texts, items, size=13):
    """{doc: (words, hit words, sorted items, contaminated)}."""
    windows, sizes = collections.defaultdict(set), set()
    for item, text in items:
        w = ITEM_WORDS.findall(lower(text))
        if w:
            k = min(size, len(w))
            sizes.add(k)
            for i in range(len(w) - k + 1):
                windows[tuple(w[i:i + k])].add(str(item))
    out = {}
    for doc, text in texts.items():
        w, hit, found = ITEM_WORDS.findall(lower(text)), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                got = windows.get(tuple(w[i:i + k]))
                if got:
                    found |= got
                    hit.update(range(i, i + k))
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = WORDS.findall(text)
    counts = collections.Counter(zip(words, words[1:], words[2:]))
    again = set()
    for i in range(len(words) - 2):
        if counts[tuple(words[i:i + 3])] > 1:
            again.update((i, i + 1, i + 2))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(again)


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(texts):
    """{doc: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    words = {d: WORDS.findall(lower(t)) + [None] for d, t in texts.items()}
    counts = collections.Counter()
    for d, w in words.items():
        if not is_held(d):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return {d: (is_held(d), len(w), sum(counts[x] > 0 for x in w), n,
                sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in w)) for d, w in words.items()}


def token_ids(texts, path, end=1):
    """{doc: ids with the end id}, by the tokenizer itself."""
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(path)
    return {d: own.encode(t or "", add_special_tokens=False).ids + [end] for d, t in texts.items()}


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept_by_pipeline(texts, items, kept_by_field):
    """Ids and texts that reach the last stage: quality (the field's verdict
    on documents past the base rules is given), one of each near-duplicate
    class, below the contamination limit, secrets replaced."""
    rows = {}
    for d, t in texts.items():
        n, _, _, _, repeat = quality(t)
        if n >= 50 and 100 * repeat <= 50 * n and kept_by_field[d]:
            rows[d] = t
    stay = classes({d: fingerprint(t) for d, t in rows.items()})
    rows = {d: t for d, t in rows.items() if stay[d] == d}
    hits = item_hits(rows, items)
    rows = {d: t for d, t in rows.items() if not hits[d][3]}
    out = {}
    for d, t in rows.items():
        text, at = "", 0
        for _, a, b in base_spans(t):
            if a > at or not text:
                text += t[at:a] + "[SECRET]"
            at = max(at, b)
        out[d] = text + t[at:]
    return out


def phrase_counts(rows, max_words=5):
    """{(lang, words): count} of rows (lang, text), and {lang: words}."""
    counts, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    return counts, n


def collocations(rows, least=100, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score)."""
    counts, n = phrase_counts(rows)
    often = {p: a for p, a in counts.items() if a >= least}
    inside = {}
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i:i + k])
                inside[part] = max(inside.get(part, 0), a)
    found = collections.defaultdict(list)
    for (lang, w), a in often.items():
        if len(w) < 2 or inside.get((lang, w), 0) >= a:
            continue
        cuts = [(1000 * a * n[lang] // (often[lang, w[:k]] * often[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), often[lang, w[:k]], often[lang, w[k:]]))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s)
            for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]


def variant_words(texts):
    """{word: n} of {doc_id: text}."""
    out = collections.Counter()
    for doc, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    """One edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def variants(words):
    """Rows (word, form, root, n, n_near, form_n)."""
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def char_models(words, toxic, ordinary, order=5, shared=3, discount=0.75, extra=4):
    """Kneser-Ney log ratios by the definition, with recursion; a function of
    a word.  ``words`` with their uses in the two classes."""
    raw = collections.defaultdict(lambda: [0, 0])
    for w, t, o in zip(words, toxic, ordinary):
        s = "\x01" + w + "\x02"
        for i in range(1, len(s)):
            for k in range(1, min(order, i + 1) + 1):
                g = s[i - k + 1:i + 1]
                raw[g][0] += o
                raw[g][1] += t
    left = [collections.Counter(), collections.Counter(), collections.Counter()]
    for g, (o, t) in raw.items():
        if len(g) > 1:
            left[0][g[1:]] += o > 0
            left[1][g[1:]] += t > 0
            left[2][g[1:]] += 1

    def count(g, y):
        whole = len(g) == order or g[0] == "\x01"
        if len(g) < shared:
            return sum(raw[g]) if whole else left[2][g]
        return raw[g][y] if whole else left[y][g]
    ends = collections.defaultdict(list)
    for g in list(raw):
        ends[g[:-1]].append(g)
    chars = len({c for w in words for c in w}) + extra

    def prob(g, y):
        if not g:
            return 1.0 / chars
        own = [count(e, y) for e in ends[g[:-1]]]
        total, low = sum(own), prob(g[1:], y)
        if not total:
            return low
        n = count(g, y) if g in raw else 0
        return max(n - discount, 0) / total + discount * sum(x > 0 for x in own) / total * low

    def ratio(w):
        s = "\x01" + w + "\x02"
        return sum(math.log(prob(s[max(0, i - order + 1):i + 1], 1) / prob(s[max(0, i - order + 1):i + 1], 0))
                   for i in range(1, len(s)))
    return ratio
