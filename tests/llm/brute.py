"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import combinations

import regex
import xxhash
import zstandard

SPACES = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[str]:
    return [
        f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in BASE[k].finditer(text or "") if valid(k, m.group())
    ]


SEED_KINDS = (*KINDS, "secret")
TOKEN = re.compile(r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*[0-9])[A-Za-z0-9._@+-]{5,}")


def all_spans(texts: dict, turns=3, least=3, confident=0.8) -> dict:
    """id: base spans, then those of trusted contexts, by kind and start, spelled out."""
    seen, edges, tokens = {}, {}, []
    for d, text in texts.items():
        text = text or ""
        matches = [(k, m) for k in KINDS for m in BASE[k].finditer(text) if valid(k, m.group())]
        seen[d] = sorted((SEED_KINDS.index(k), m.start(), m.end()) for k, m in matches)
        for kind, m in [*matches, *((None, m) for m in TOKEN.finditer(text))]:
            before = text[max(0, m.start() - 60) : m.start()]
            words = re.search(r"(?:^|\s)(\S+\s+\S+?)\s*[\"'(:=]*$", before.lower())
            pattern = words and re.sub("[0-9]", "0", re.sub(r"\s+", " ", words[1]))
            if not pattern:
                continue
            if kind is None:
                tokens.append((d, m.start(), m.end(), pattern))
                hexadecimal = re.fullmatch("[0-9A-Fa-f]{32,}", m.group()) and re.search("[A-Fa-f]", m.group())
                kind = "secret" if hexadecimal and re.search(r"[=:]\s*[\"']$", before) else None
            edges.setdefault(pattern, {}).setdefault(m.group().lower(), set()).add(kind)
    edges = {p: found for p, found in edges.items() if len(found) >= least}
    seeds = {}
    for found in edges.values():
        for instance, kinds in found.items():
            seeds.setdefault(instance, set()).update(kinds - {None})
    scores = {i: {k: float(k in kinds) for k in SEED_KINDS} for i, kinds in seeds.items()}
    for _ in range(turns):
        confidence = {}
        for p, found in edges.items():
            for k in SEED_KINDS:
                of_kind = [scores[i][k] for i in found]
                mean = sum(of_kind) / len(of_kind)
                confidence[p, k] = mean if mean >= confident and sum(s > 0 for s in of_kind) >= least else 0.0
        for i in (i for i, kinds in seeds.items() if not kinds):
            scores[i] = {k: max(confidence[p, k] for p in edges if i in edges[p]) for k in SEED_KINDS}
    for d, start, end, p in tokens:
        kind = max(SEED_KINDS, key=lambda k: confidence.get((p, k), 0.0))
        taken = any(a < end and start < b for r, a, b in seen[d] if r < len(KINDS))
        if confidence.get((p, kind), 0.0) and not taken:
            seen[d].append((SEED_KINDS.index(kind), start, end))
    return {d: [f"{SEED_KINDS[r]}:{a}:{b}" for r, a, b in sorted(spans)] for d, spans in seen.items()}


def shingle_set(text: str | None, size: int) -> frozenset:
    words = [w for w in SPACES.split((text or "").translate(UPPER)) if w]
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_components(rows, size: int, num: int, den: int) -> dict:
    """id: (set size, smallest id of the component), by comparing every pair."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(sets, 2):
        both = len(sets[a] | sets[b])
        if both and den * len(sets[a] & sets[b]) >= num * both:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def leaks(text: str | None, items, window: int = 10) -> tuple[int, int, list[str]]:
    """Words, words hit, ids of the items that occur."""
    words, hit, ids = bench_words(text), set(), set()
    for item_id, item in items:
        w = bench_words(item)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                ids.add(str(item_id))
    return len(words), len(hit), sorted(ids)


class VisibleText(HTMLParser):
    """All character data outside scripts, styles and titles."""

    def __init__(self):
        super().__init__()
        self.skip, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def quality_scores(texts, labels):
    """Scores of all texts, learned from ``labels`` (every id once, fewer than a sample of each label)."""
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 7), 42)
    turn = lambda d: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", d), seed)))[0]
    rows = {k: sorted((turn(d), texts[d]) for d, q in labels if q == k and texts.get(d)) for k in (0, 1)}
    coders = {}
    for k, own in rows.items():
        data = [t.encode() for i, (_, t) in enumerate(own) if i % 3]
        pieces = [d[i : i + 512] for d in data for i in range(0, len(d), 512)]
        trained = zstandard.train_dictionary(112_640, pieces)
        coders[k] = zstandard.ZstdCompressor(
            level=3, dict_data=trained, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def difference(text):
        data = (text or "").encode()
        blocks = [data[i : i + 2048] for i in range(0, max(len(data), 1), 2048)]
        bad, good = (sum(len(coders[k].compress(b)) for b in blocks) for k in (0, 1))
        return (bad - good) / (bad + good)

    held = {k: [difference(t) / 0.01 for _, t in own[::3]] for k, own in rows.items()}
    share = {k: len(own) / len(held[k]) for k, own in rows.items()}
    scale = sum(map(len, held.values())) / sum(map(len, rows.values()))
    points = [(x, k, share[k] * scale) for k, xs in held.items() for x in xs]
    curve = lambda a, b, x: 1 / (1 + math.exp(-max(-30, min(30, a * x + b))))
    a = b = 0.0
    for _ in range(200):  # Newton steps over two unknowns, lightly penalised
        g, h, aa, ab, bb = 1e-3 * a, 1e-3 * b, 1e-3, 0.0, 1e-3
        for x, k, w in points:
            p = curve(a, b, x)
            g, h = g + w * (p - k) * x, h + w * (p - k)
            c = w * p * (1 - p)
            aa, ab, bb = aa + c * x * x, ab + c * x, bb + c
        det = aa * bb - ab * ab
        da, db = (bb * g - ab * h) / det, (aa * h - ab * g) / det
        a, b = a - max(-5, min(5, da)), b - max(-5, min(5, db))
    return {d: curve(a, b, difference(t) / 0.01) for d, t in texts.items()}


def language(text, learned):
    """Language and score of a text, from ``(text, language)`` rows."""
    counts = _language_counts(tuple(learned))
    langs = sorted(counts[0])
    words = regex.findall(r"\p{L}+", (text or "").lower())
    if not words or not langs:
        return "und", 0.0
    sums = {order: {lang: sum(c.values()) for lang, c in by.items()} for order, by in counts.items()}
    floor = {order: math.log(0.5) - math.log(max(of.values())) for order, of in sums.items()}

    def log(order, item, lang):
        n = counts[order][lang].get(item, 0)
        return math.log(n) - math.log(sums[order][lang]) if n else floor[order]

    total = dict.fromkeys(langs, 0.0)
    for word in words:
        if any(word in counts[0][lang] for lang in langs):
            for lang in langs:
                total[lang] += log(0, word, lang)
            continue
        marked = f"\u0002{word}\u0002"
        for step, k in enumerate((4, 3, 2, 1), 1):
            grams = [marked[i : i + k] for i in range(len(marked) - k + 1)]
            if any(g in counts[k][lang] for g in grams for lang in langs):
                for lang in langs:
                    total[lang] += sum(log(k, g, lang) for g in grams) / len(grams) - 0.7 * step
                break
    best = max(langs, key=lambda lang: total[lang])
    return best, 1 / sum(math.exp(max(total[lang] - total[best], -700)) for lang in langs)


@functools.cache
def _language_counts(learned):
    counts = {order: defaultdict(Counter) for order in (0, 1, 2, 3, 4)}
    for text, lang in learned:
        for word in regex.findall(r"\p{L}+", (text or "").lower()):
            counts[0][lang][word] += 1
    for lang, words in counts[0].items():
        for word, n in words.items():
            marked = f"\u0002{word}\u0002"
            for k in (1, 2, 3, 4):
                for i in range(len(marked) - k + 1):
                    counts[k][lang][marked[i : i + k]] += n
    return counts
