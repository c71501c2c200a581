"""Repair of text from scanned pages.

Lines that belong to the page are found first: running headers and footers (lines at a page's edge that recur on pages
nearby, up to misread letters and numbers) and page numbers (a number at a page's edge that runs with the pages).
Of the other lines a noisy channel restores the words.

Channel. Two words are neighbours if they have the same strokes (m as r n, n as r i, d as c l, ...: characters are written as the strokes by which
they are confused) or if they differ by one inserted, lost, replaced or swapped character. Neighbours are found by joining all
distinct words of the corpus on keys. The probability of every confusion is estimated by expectation maximisation over all pairs
of neighbours: a rare word x beside a frequent w is either a word of its own or what is left of w's misreadings, whose number follows a
geometric distribution around (count of w) x (confusion probability). The words that stand before x count too: where x has other company than w,
it is a word of its own. So every word has a probability of being real, and nothing is struck from the language.

Decoding. Every token keeps itself as a candidate, beside its neighbours; a candidate costs the negative logarithm of its bigram likelihood (corpus counts,
its own occurrence left out) plus that of its confusions; Viterbi finds the cheapest words of a line, and a line is
misread where they differ from what is seen. A word broken at a line's end is joined where the corpus knows the joined word better than the
hyphenated one, across pages too.

Scale. Pages are grouped by attachment and block of BLOCK pages, with the pages around as a halo, so no attachment comes to one task. Corpus
statistics cover all words and bigrams. They are broadcast only while they have at most LEXICON_ROWS rows; beyond, the rows
that a group of pages needs are joined to it (``_local``), with the same result.

Defined results: null texts have no lines and no repaired text; pages extracted twice count once (of different texts the
latest extraction's, then the largest); rows with a null attachment or page number take no part; attachments whose pages end
before the third have no running lines or page numbers; page numbers below 1 are repaired by themselves; line numbers count from 1 in the
text split at line feeds, blank lines included.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise

#: Pages of a group, and pages on either side that a line or number may recur on.
BLOCK, HALO = 256, 12
#: Rows of words and bigrams up to which the corpus statistics are broadcast (some 20 bytes each).
LEXICON_ROWS = 3_000_000
#: Pages that share one part of the statistics beyond that.
SHARE = 2000
#: Chance that the spelling of a neighbour is a word of its own, by strokes and by plain edits (inflections); factor for every
#: further confusion in a word, since bad pages have several.
REAL, AGAIN = {True: 1e-3, False: 1e-2}, 10.0
#: First guess of a confusion's probability, high, since the estimation comes down by itself but doesn't climb where all counts are large; the
#: probability of one never met, and the number of characters that a plain edit may bring in.
FIRST, UNMET, ALPHABET = {True: 1e-2, False: 1e-3}, 1e-4, 36
HYPHENS = "-­‐¬"
#: Strokes: the spelling by which a character is confused with others; fixed values.
STROKES = {
    "0": "o", "5": "s", "8": "b", "6": "b", "1": "l", "i": "l", "|": "l", "!": "l", "@": "a", "e": "c", "f": "t", "q": "g", "y": "v",
    "9": "g", "n": "rl", "m": "rrl", "u": "ll", "h": "ll", "w": "vv", "d": "cl",
}
EXPAND = str.maketrans(STROKES)
OUTER = ".,;:()[]{}\"'?“”‘’/"
NUMERIC = re.compile(r"[\d.,;:()/%$§-]+|\d+(?:\([a-z0-9]+\))+|[A-Za-z]-\d+[A-Za-z]?|\d+(?:st|nd|rd|th|d)|[ivx]+|[A-Z](?:\.[A-Z])+", re.I)
DIGIT = str.maketrans("lI|!OoSsB", "111100558")
NUMBER = re.compile(r"(?P<mark>\[|-\s*|–\s*|page\s*\|?\s*|paqe\s*\|?\s*|pg?\.\s*)?(?P<n>[\dlI|!OoSsB]+|[ivxlc]+)(?P<rest>\s*\]|\s*[-–]|\s*(?:of|/)\s*[\dlI|!OoSsB]+)?", re.I)
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


@lru_cache(1 << 18)
def strokes(word: str) -> str:
    return word.lower().translate(EXPAND)


def form(line: str) -> str:
    """What is left of a line without numbers, spaces, signs and the difference of confused letters."""
    return re.sub("[^a-z]+", "", strokes(re.sub("[0-9]+", "", line)))


def page_value(line: str) -> tuple[int, bool] | None:
    """The number on a line that holds nothing else, and whether it is marked as a page's."""
    m = NUMBER.fullmatch(line.strip())
    if not m:
        return None
    n, marked = m["n"], bool(m["mark"] or m["rest"])
    if re.fullmatch("[ivxlc]+", n, re.I) and not (marked and re.fullmatch("[lIi]+", n)):
        values = [ROMAN[c] for c in n.lower()]
        total = sum(-v if any(w > v for w in values[i + 1 :]) else v for i, v in enumerate(values))
        return total, marked or set(n.lower()) <= set("ivx")
    if not marked and not re.search(r"\d", n):
        return None
    return int(n.translate(DIGIT)) if n.translate(DIGIT).isdigit() and len(n) <= 6 else None, marked


@lru_cache(1 << 16)
def alike(a: str, b: str, least: float = 0.85) -> bool:
    """Whether two forms are readings of one line, one of them perhaps cut short."""
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) < 6 or len(short) < 0.6 * len(long):
        return False

    def close(x: str, y: str, least: float) -> bool:
        m = SequenceMatcher(None, x, y, autojunk=False)
        return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

    return close(short, long, least) or close(short, long[: len(short)], least + 0.05)


@lru_cache(1 << 16)
def signature(f: str) -> np.ndarray:
    """512 bits, one set for each three letters in a row: a form lacks few of those of one that is like it."""
    bits = np.zeros(512, np.uint8)
    c = np.frombuffer(f.encode("ascii"), np.uint8).astype(np.uint32)
    bits[((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) * np.uint32(2654435761)) >> 23] = 1
    return np.packbits(bits).view(np.uint64)


def page_lines(pages: list[tuple[int, list[tuple[int, str]]]]) -> list[dict[int, str]]:
    """Kinds of the lines that belong to the page, of successive pages (number, lines with text).

    The two outer lines at either edge are looked at, and further ones while all outside them belong to the page.
    """
    numbers = np.array([n for n, _ in pages])
    low, high = np.searchsorted(numbers, numbers - HALO), np.searchsorted(numbers, numbers + HALO, "right")
    deep = {(i, top): 2 for i in range(len(pages)) for top in (True, False)}
    form_of, value_of = lru_cache(None)(form), lru_cache(None)(page_value)
    while True:
        edges: list[list[tuple[int, str]]] = []
        for i, (_, lines) in enumerate(pages):
            a, b = deep[i, True], deep[i, False]
            edges.append(lines if len(lines) <= a + b else lines[:a] + lines[-b:])
        out = _classify(numbers, low, high, edges, form_of, value_of)
        grown = False
        for i, (_, lines) in enumerate(pages):
            for top in (True, False):
                n = deep[i, top]
                if len(lines) > n and all(no in out[i] for no, _ in (lines[:n] if top else lines[-n:])):
                    deep[i, top], grown = n + 1, True
        if not grown:
            return out


def _classify(numbers: np.ndarray, low: np.ndarray, high: np.ndarray, edges: list, form_of, value_of) -> list[dict[int, str]]:
    out: list[dict[int, str]] = [{} for _ in edges]
    begins, ends, numbers = low.tolist(), high.tolist(), numbers.tolist()
    shifts: dict[int, list[int]] = defaultdict(list)
    places: dict[str, list[int]] = defaultdict(list)
    rows: list[tuple[int, int, str]] = []
    for i, lines in enumerate(edges):
        seen, seen_forms = set(), set()
        for no, line in lines:
            value = value_of(line)
            if value:
                if value[0] is not None and value[0] - numbers[i] not in seen:
                    seen.add(value[0] - numbers[i])
                    shifts[value[0] - numbers[i]].append(i)
            elif len(f := form_of(line)) >= 4:
                rows.append((i, no, f))
                if f not in seen_forms:
                    seen_forms.add(f)
                    places[f].append(i)

    def around(at: list[int], i: int) -> int:
        """Pages among ``at`` in the window of page i."""
        return bisect_left(at, ends[i]) - bisect_left(at, begins[i])

    for i, lines in enumerate(edges):
        for no, line in lines:
            value = value_of(line)
            if value and (value[1] or (value[0] is not None and around(shifts[value[0] - numbers[i]], i) > 1)):
                out[i][no] = "page_number"
    need = np.full(len(edges), max(2, 0.25 * min(len(edges), 2 * HALO + 1)))
    again = {(i, f): around(places[f], i) for i, _, f in rows}
    open_rows = []
    for i, no, f in rows:
        if again[i, f] >= need[i]:
            out[i][no] = "running"
        else:
            open_rows.append((i, no, f))
    if not open_rows:
        return out
    page_of = np.array([i for i, _, _ in rows])
    lengths = np.array([len(f) for _, _, f in rows])
    times = np.array([again[i, f] for i, _, f in rows])
    signs = np.stack([signature(f) for _, _, f in rows])
    first, last = np.searchsorted(page_of, low), np.searchsorted(page_of, high)
    for i, no, f in open_rows:
        part, own, n = slice(first[i], last[i]), signature(f), len(f)
        other = lengths[part]
        # the known confusions leave the form as it is, so forms that never come again must be very much like each other
        strict = np.maximum(times[part], again[i, f]) == 1
        # a character without a counterpart takes three of the form's runs of three letters with it at most
        missing = np.where(other < n, np.bitwise_count(signs[part] & ~own).sum(1), np.bitwise_count(own & ~signs[part]).sum(1))
        short = np.minimum(other, n)
        likely = (missing <= 3 * (np.where(strict, 0.07, 0.15) * short + 1e-9).astype(int)) & (short >= 0.6 * np.maximum(other, n)) & (page_of[part] != i)
        support: dict[int, int] = {}
        for j in np.flatnonzero(likely):
            k, _, g = rows[j + part.start]
            if k not in support and alike(f, g, 0.93 if strict[j] else 0.85):
                support[k] = again[k, g]
        if support and (1 + len(support) >= need[i] or max(support.values()) >= need[i]):
            out[i][no] = "running"
    return out


def tokens(line: str) -> list[str]:
    return line.replace("\r", " ").split()


@lru_cache(1 << 17)
def core_of(token: str) -> tuple[str, str, str]:
    """Outer signs, the word, outer signs."""
    left = len(token) - len(token.lstrip(OUTER))
    word = token[left:].rstrip(OUTER)
    return token[:left], word, token[left + len(word) :]


@lru_cache(1 << 17)
def is_word(word: str) -> bool:
    return sum(c.isalpha() for c in word) >= 2 and not NUMERIC.fullmatch(word)


def broken(line: str) -> str | None:
    """The beginning of a word broken at the line's end."""
    last = line.rstrip().rpartition(" ")[2]
    return last[:-1] if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalpha() else None


class Lexicon:
    """Words and bigrams of the corpus (or what some pages need of them), and the channel.

    counts: occurrences by word. real: probability of being a word of its own, where it isn't 1. neighbours: by word, the words that it can be
    a misreading of, with the negative log probability. strokes: real words by their strokes. channel: negative log probability by confusion.
    """

    def __init__(self, total: int, counts: dict[str, int], real: dict[str, float], neighbours: dict[str, list[tuple[str, float]]], stroked: dict[str, list[str]], bigrams: tuple[np.ndarray, np.ndarray], channel: dict[str, float]):
        self.total = max(1, total)
        self.counts, self.real, self.neighbours, self.stroked, self.channel = counts, real, neighbours, stroked, channel
        self.keys, self.numbers = bigrams
        self.known: dict[str, tuple] = {}
        #: tokens that stay as they are wherever they stand
        self.calm: set[str] = set()

    def needs_nothing(self, token: str, known: tuple) -> bool:
        if len(self.calm) > 500_000:
            self.calm.clear()
        _, word, _, low, spoken, other = known
        if token in ("-", "–"):
            return False
        return not spoken or not other and not ("-" in low and low not in self.counts) and not ("I" in word[1:] and not word.isupper())

    def token(self, token: str) -> tuple[str, str, str, str, bool, bool]:
        """Outer signs, the word, outer signs, the word in lower case, whether it is one and whether it may be another."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            a, word, b = core_of(token)
            low = word.lower()
            found = self.known[token] = (a, word, b, low, is_word(word), low in self.neighbours)
        return found

    def count(self, word: str) -> int:
        """How often the corpus has the word, if it is likely one."""
        return self.counts.get(word, 0) if self.real.get(word, 1.0) >= 0.5 else 0

    def best(self, word: str) -> str:
        """The likeliest word for one that stands alone."""
        if word in self.counts:
            if self.real.get(word, 1.0) >= 0.5:
                return word
            return min(self.neighbours.get(word, ()), key=lambda x: x[1] - math.log(self.counts.get(x[0], 0) + 0.1), default=(word,))[0]
        return max(self.stroked.get(strokes(word), ()), key=lambda w: (self.counts.get(w, 0), w), default=word)

    def language(self, before: str, word: str, seen: str | None = None) -> float:
        """Negative log of the bigram likelihood, interpolated with the word's own. ``seen``: what stands there; its occurrence doesn't count.

        What a doubtful word was seen with counts by the chance of its being one.
        """
        real = self.real.get(word, 1.0)
        self_ = 1 if word == seen else 0
        own = (max(0, self.counts.get(word, 0) - self_) * real + 0.01) / self.total
        bigram = 0.0
        if before:
            n = self.pair(before, word) - self_
            if n > 0:
                bigram = n * real * real / (self.counts.get(before, 0) + 2)
        return -math.log(0.7 * min(1.0, bigram) + 0.3 * own)

    def pair(self, before: str, word: str) -> int:
        if not len(self.keys):
            return 0
        key = bigram_key(before, word)
        i = int(np.searchsorted(self.keys, key))
        return int(self.numbers[i]) if i < len(self.keys) and self.keys[i] == key else 0

    def options(self, word: str) -> list[tuple[str, float]]:
        return [(word, 0.0), *self.neighbours.get(word, ())]

    def decode(self, seen: list[str]) -> list[str]:
        """The cheapest words for a line's tokens (in lower case), by Viterbi."""
        if not any(w in self.neighbours for w in seen):
            return seen
        paths: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
        for token in seen:
            following = {}
            for word, channel in self.options(token):
                following[word] = min((cost + channel + self.language(before, word, token), (path, word)) for before, (cost, path) in paths.items())
            paths = following
        path = min(paths.values(), key=lambda x: x[0])[1]
        out = []
        while path:
            path, word = path
            out.append(word)
        return out[::-1]


def bigram_key(a: str, b: str) -> int:
    """As the engine's xxhash64 of the two words with a blank between."""
    return int(np.uint64(xxhash.xxh64_intdigest(f"{a} {b}", seed=42)).astype(np.int64))


def confusions(word: str, seen: str) -> list[tuple[str, str]]:
    """The fewest replacements (of one or two characters) by which ``word`` is read as ``seen``."""
    n, m = len(word), len(seen)
    best: list[list[tuple[int, tuple | None]]] = [[(10**6, None)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0, None)
    for i in range(n + 1):
        for j in range(m + 1):
            cost, _ = best[i][j]
            if cost >= 10**6:
                continue
            if i < n and j < m and word[i] == seen[j] and cost < best[i + 1][j + 1][0]:
                best[i + 1][j + 1] = (cost, (i, j))
            for a in (1, 2):
                for b in (1, 2) if a == 1 else (1,):
                    if i + a <= n and j + b <= m and cost + 1 < best[i + a][j + b][0] and strokes(word[i : i + a]) == strokes(seen[j : j + b]):
                        best[i + a][j + b] = (cost + 1, (i, j))
    if best[n][m][1] is None:
        return [(word, seen)]
    out, i, j = [], n, m
    while (i, j) != (0, 0):
        p, q = best[i][j][1]
        if word[p:i] != seen[q:j]:
            out.append((word[p:i], seen[q:j]))
        i, j = p, q
    return out[::-1]


def like(word: str, seen: str) -> str:
    """``word`` in the case of ``seen``."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and sum(c.isupper() for c in letters) > 0.7 * len(letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and seen[:1].isupper() else word


def joined(lex: Lexicon, left: str, right: str, soft: bool) -> str | None:
    """The whole word if ``left`` and ``right`` are parts of one that is normally written without a hyphen."""
    left, right = left.lower().lstrip(OUTER), right.lower()
    whole, hyphenated = lex.best(left + right), lex.best(f"{left}-{right}")
    if lex.count(whole) and lex.count(whole) >= lex.count(hyphenated):
        return whole
    if lex.count(hyphenated):
        return None
    parts = (left.rpartition("-")[2] or left, right)
    if all(lex.count(lex.best(p)) > 0 for p in parts) and not soft:
        return None
    tail = lex.best(parts[0] + right)  # a compound whose last part is broken
    if "-" in left and lex.count(tail):
        return left[: len(left) - len(parts[0])] + tail
    return left + right


def repair(text: str, kinds: dict[int, str], lex: Lexicon, after: str | None, before: str | None) -> tuple[list[tuple[int, str]], str]:
    """Kinds of the page's lines and its repaired text.

    after: the first word of the next page's text; before: the broken word that the page before ends with.
    """
    lines = text.split("\n")
    found = [(no, kind) for no, kind in kinds.items()]
    body = [i for i, line in enumerate(lines) if line.strip() and i + 1 not in kinds]
    misread: set[int] = set()
    done: list[list[str]] = []  # words of each body line
    skip_first = False
    if body and before and tokens(lines[body[0]]) and any(c.isalpha() for c in tokens(lines[body[0]])[0]):
        skip_first = True
        part = core_of(tokens(lines[body[0]])[0])[1]
        whole = joined(lex, core_of(before[:-1])[1], part, before[-1] != "-")
        if whole is not None and not whole.endswith(part.lower()):
            misread.add(body[0] + 1)
    for at, i in enumerate(body):
        toks = tokens(lines[i])
        first = skip_first
        skip_first = False
        stem = broken(lines[i])
        following = tokens(lines[body[at + 1]])[:1] if at + 1 < len(body) else [after] if after else []
        end: str | None = None
        if stem is not None and following and any(c.isalpha() for c in following[0]):
            part = core_of(following[0])[1]
            whole = joined(lex, core_of(stem)[1], part, lines[i].rstrip()[-1] != "-")
            if whole is not None:
                found.append((i + 1, "hyphen"))
                left = core_of(stem)[1].lower()
                if not whole.startswith(left):
                    misread.add(i + 1)
                if not whole.endswith(part.lower()) and at + 1 < len(body):
                    misread.add(body[at + 1] + 1)
                prefix = core_of(stem)[0]
                end = prefix + like(whole, core_of(stem)[1]) + core_of(following[0])[2]
                skip_first = at + 1 < len(body)
            else:
                end = toks[-1][:-1] + "-" + following[0]
                skip_first = at + 1 < len(body)
                for no, w in ((i, core_of(stem)[1]), (body[at + 1] if at + 1 < len(body) else None, part)):
                    if no is not None and is_word(w) and not lex.count(w.lower()) and lex.best(w.lower()) != w.lower() and not lex.count(f"{core_of(stem)[1]}-{part}".lower()):
                        misread.add(no + 1)
        words = toks[1:] if first else toks
        if end is not None and words:
            words = words[:-1]
        if lex.calm.issuperset(words):
            done.append([*words, end] if end is not None else words)
            continue
        plain = [lex.token(t) for t in words]
        lex.calm.update(t for t, x in zip(words, plain, strict=True) if lex.needs_nothing(t, x))
        spoken = [k for k, t in enumerate(plain) if t[4]]
        fixed = lex.decode([plain[k][3] for k in spoken])
        out = list(words)
        for k, word in zip(spoken, fixed, strict=True):
            a, seen, b, low = plain[k][:4]
            if word == low:
                if low not in lex.counts and "-" in low:  # a compound whose parts are to be read apart
                    parts = low.split("-")
                    read = [lex.best(p) if is_word(p) and not lex.count(p) else p for p in parts]
                    if read != parts:
                        misread.add(i + 1)
                        out[k] = a + "-".join(like(r, p) for r, p in zip(read, seen.split("-"), strict=True)) + b
                elif "I" in seen[1:] and not seen.isupper() and any(c.islower() for c in seen):
                    misread.add(i + 1)
                continue
            misread.add(i + 1)
            out[k] = a + like(word, seen) + b
        out = [t for k, t in enumerate(out) if not (t in ("-", "–") and 0 < k < len(out) - 1 and lex.language(core_of(out[k - 1])[1].lower(), core_of(out[k + 1])[1].lower()) < 8)]
        if end is not None:
            out.append(end)
        done.append(out)
    found += [(no, "misread") for no in misread]
    paragraphs: list[list[str]] = []
    last, apart = None, False
    for at, (i, words) in enumerate(zip(body, done, strict=True)):
        line = lines[i].strip()
        ended = last is None or lines[last].rstrip()[-1:] in ".?!:"
        upper = at + 1 < len(body) and lines[body[at + 1]].lstrip()[:1].isupper()
        heading = len(words) <= 4 and line[:1].isupper() and line[-1:].isalpha() and ended and upper
        if apart or heading or last is None or any(not lines[j].strip() for j in range(last + 1, i)):
            paragraphs.append([])
        paragraphs[-1] += words
        last, apart = i, heading
    return sorted(set(found)), "\n\n".join(" ".join(p) for p in paragraphs if p)



PAGE = "stable_id string, page_num long, text string, flags array<int>, kinds array<string>, after string, before string"
GROUP = "stable_id string, block long"


def _page_rows(df: DataFrame) -> DataFrame:
    """stable_id, block, page_num, text, at: every page in its block and in those to which it is halo, and a row without a page for
    the first block of attachments with a third page."""
    at = F.col("extracted_at").cast("string") if "extracted_at" in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col("stable_id").cast("string").alias("stable_id"), F.col("page_num").cast("long").alias("page_num"), F.col("text"), at.alias("at")).where("stable_id is not null and page_num is not null")
    page = F.col("page_num")
    blocks = F.when(page < 1, F.array(F.lit(-1).cast("long"))).otherwise(F.array_distinct(F.array(*(F.floor(F.greatest(page + d, F.lit(1)) / BLOCK) for d in (0, -HALO, HALO)))))
    large = rows.groupBy("stable_id").agg(F.max("page_num").alias("m")).where("m > 2").select("stable_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast("long").alias("page_num"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("at"))
    return rows.select("stable_id", F.explode(blocks).alias("block"), "page_num", "text", "at").unionByName(large)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class Counts:
    """Words and bigrams (prev null or the word before) of lines, broken words aside.

    Tokens are counted as they stand; their words are taken of the different ones only, when the counts are handed on.
    """

    def __init__(self) -> None:
        self.tokens: Counter[str] = Counter()
        self.pairs: Counter[tuple[str, str]] = Counter()

    def add(self, lines: list[str]) -> None:
        cut, first, every = True, True, []  # the first word of a page may be the end of another
        for line in lines:
            toks = line.split()
            if not toks:
                continue
            last = toks[-1]
            ends = len(last) > 1 and last[-1] in HYPHENS and last[-2].isalpha()
            if cut or first:
                toks[0] = ""
            if ends:
                toks[-1] = ""
            every += toks
            every.append("")
            cut, first = ends, False
        self.tokens.update(every)
        self.pairs.update(zip(every, every[1:], strict=False))

    def __len__(self) -> int:
        return len(self.tokens) + len(self.pairs)

    def flush(self) -> tuple[list, list, list]:
        word = {t: w if len(w) <= 60 and is_word(w) else "" for t, w in ((t, _low(t)) for t in self.tokens)}
        words: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        for t, n in self.tokens.items():
            words[word[t]] += n
        for (a, b), n in self.pairs.items():
            if word[a] and word[b]:
                pairs[word[a], word[b]] += n
        words.pop("", None)
        self.__init__()
        return [None] * len(words) + [k[0] for k in pairs], [*words, *(k[1] for k in pairs)], [*words.values(), *pairs.values()]


@lru_cache(1 << 17)
def _low(token: str) -> str:
    return core_of(token)[1].lower()


def _read(df: DataFrame) -> DataFrame:
    """Two kinds of rows from one pass over the texts: pages (PAGE) and counts (prev, word, n)."""
    names = [c.split()[0] for c in PAGE.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string()]

    def pages_of(group: tuple, rows: list[tuple], counts: Counts) -> list[tuple]:
        sid, block = group
        large, best = block > 0, {}
        for page, text, at in rows:
            if page is None:
                large = True
            elif page not in best or (text is not None, at or "", text or "") > (best[page][0] is not None, best[page][1] or "", best[page][0] or ""):
                best[page] = (text, at)
        pages = [(page, text, [(i, line.strip()) for i, line in enumerate(text.split("\n"), 1) if line.strip()]) for page, (text, _) in sorted(best.items()) if text is not None]
        kinds = page_lines([(page, lines) for page, _, lines in pages]) if large and block >= 0 else [{} for _ in pages]
        bodies = [[line for no, line in lines if no not in marked] for (_, _, lines), marked in zip(pages, kinds, strict=True)]
        full = [i for i, body in enumerate(bodies) if body]
        out = []
        for i, ((page, text, _), marked) in enumerate(zip(pages, kinds, strict=True)):
            if block >= 0 and page // BLOCK != block:
                continue
            after = before = None
            if block >= 0 and bodies[i]:
                k = full.index(i) if len(full) < 40 else int(np.searchsorted(full, i))
                after = tokens(bodies[full[k + 1]][0])[0] if k + 1 < len(full) else None
                tail = bodies[full[k - 1]][-1] if k else ""
                before = broken(tail) and broken(tail) + tail.rstrip()[-1]
            counts.add(bodies[i])
            out.append((sid, page, text, list(marked), list(marked.values()), after, before))
        return out

    def batch(rows: list[tuple], counted: tuple[list, list, list] | None = None) -> pa.RecordBatch:
        prev, word, n = counted or ([], [], [])
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        none = [None] * len(word)
        arrays = [pa.array([*c, *none], t) for c, t in zip(cols, types, strict=True)]
        pad = [None] * len(rows)
        return pa.RecordBatch.from_arrays([*arrays, pa.array([*pad, *prev], pa.string()), pa.array([*pad, *word], pa.string()), pa.array([*pad, *n], pa.int64())], names=[*names, "prev", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, done, counts = None, [], [], Counts()
        for b in batches:
            for sid, block, page, text, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (sid, block) != group:
                    if group is not None:
                        done += pages_of(group, rows, counts)
                    group, rows = (sid, block), []
                    if len(done) >= 500:
                        yield batch(done)
                        done = []
                        if len(counts) > 600_000:
                            yield batch([], counts.flush())
                rows.append((page, text, at))
        if group is not None:
            done += pages_of(group, rows, counts)
        yield batch(done, counts.flush())

    placed = _page_rows(df).repartition(_tasks(df), "stable_id", "block").sortWithinPartitions("stable_id", "block", "page_num")
    return placed.mapInArrow(run, f"{PAGE}, prev string, word string, n long")


def edits(word: str, seen: str) -> list[tuple[str, str]] | None:
    """The one plain edit that makes ``seen`` of ``word``, or None."""
    i = 0
    while i < min(len(word), len(seen)) and word[i] == seen[i]:
        i += 1
    a, b = word[i:], seen[i:]
    if len(word) == len(seen):
        if a[1:] == b[1:]:
            return [("*", "replaced")]
        return [("*", "swapped")] if a[:2] == b[1::-1] and a[2:] == b[2:] else None
    return [("*", "lost")] if a[1:] == b else [("*", "inserted")] if a == b[1:] else None


def neighbour_keys(word: str) -> list[str]:
    """Two words with a key in common may be neighbours: the strokes, and for plain edits the word without one character."""
    out = {"=" + strokes(word)}
    if len(word) >= 5:
        out.add(word)
    if len(word) >= 5:
        out.update(word[:i] + word[i + 1 :] for i in range(len(word)))
    return sorted(out)


def _pairs(types: DataFrame) -> DataFrame:
    """x, nx, w, nw and ops: what a word x could be a misreading of, with the confusions that make it of w."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            made = [neighbour_keys(w) for w in words]
            at = np.repeat(np.arange(len(words)), [len(k) for k in made])
            yield pa.RecordBatch.from_arrays([pa.array([k for ks in made for k in ks], pa.string()), b.column(0).take(pa.array(at)), pa.array(n[at])], names=["key", "word", "n"])

    def within(key: str, members: list[tuple[int, str]]) -> Iterator[tuple]:
        members.sort(key=lambda m: (-m[0], m[1]))
        top = members[0][0]
        for j, (nx, x) in enumerate(members):
            for nw, w in members[:j]:
                # a neighbour is more frequent, and no misreading itself by its look: well attested or the first of all
                if nw <= nx or (nw < 10 and nw < top):
                    break
                if key[0] == "=":
                    yield x, nx, w, nw, [a + ">" + b for a, b in confusions(w, x)], True
                elif strokes(w) != strokes(x):
                    found = edits(w, x)
                    if found:
                        yield x, nx, w, nw, [a + ">" + b for a, b in found], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members, out = None, [], []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_()), strict=True)], names=["x", "nx", "w", "nw", "ops", "stroke"])

        for b in batches:
            for key, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != last:
                    if len(members) > 1:
                        out.extend(within(last, members))
                    last, members = key, []
                    if len(out) > 50_000:
                        yield batch()
                        out = []
                members.append((n, word))
        if len(members) > 1:
            out.extend(within(last, members))
        yield batch()

    keyed = types.select("word", "n").repartition(_tasks(types)).mapInArrow(keys, "key string, word string, n long")
    found = keyed.repartition(_tasks(types), "key").sortWithinPartitions("key").mapInArrow(run, "x string, nx long, w string, nw long, ops array<string>, stroke boolean")
    return found.dropDuplicates(["x", "w"])


def misread_share(n: np.ndarray, expected: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Probability that n occurrences are misreadings, of which ``expected`` are expected, and no word of its own."""
    expected = np.maximum(expected, 1e-300)
    wrong = -np.log1p(expected) + n * (np.log(expected) - np.log1p(expected))
    own = np.log(chance) - np.log(n) - np.log(n + 1.0)
    return 1 / (1 + np.exp(np.clip(own - wrong, -700, 700)))


def _channel(pairs: DataFrame, types: DataFrame) -> dict[str, float]:
    """Probability of each confusion, by expectation maximisation over all pairs with one confusion.

    Only (confusion, counts of both words) matter to it, so the pairs are counted by these first, larger counts by steps of a tenth.
    The table has a fixed size: there are finitely many confusions of strokes.
    """
    step = lambda c: F.when(F.col(c) <= 20, F.col(c).cast("double")).otherwise(F.exp(F.floor(F.log(c) * 10) / 10))
    table = pairs.where(F.size("ops") == 1).groupBy(F.element_at("ops", 1).alias("op"), "stroke", step("nx").alias("nx"), step("nw").alias("nw")).agg(F.count("*").alias("m")).toPandas()
    sources = sorted({op.split(">")[0] for op in table["op"]} - {"*"})
    # how often a confusion had its chance: occurrences of its source in all words
    had = types.agg(F.sum(F.col("n") * F.length("word")).alias("*"), *(F.sum(F.col("n") * ((F.length("word") - F.length(F.replace("word", F.lit(a), F.lit("")))) / len(a))).alias(f"s{i}") for i, a in enumerate(sources))).first()
    chances = {"*": float(had[0] or 1)} | {a: float(had[i + 1] or 1) for i, a in enumerate(sources)}
    if not len(table):
        return {}
    ops = table["op"].unique().tolist()
    which = table["op"].map({op: i for i, op in enumerate(ops)}).to_numpy()
    many = np.array([ALPHABET if op in ("*>inserted", "*>replaced") else 1 for op in ops], float)
    base = np.array([chances[op.split(">")[0]] for op in ops])
    first = table.groupby("op")["stroke"].first()[ops].map(FIRST).to_numpy()
    chance = table["stroke"].map(REAL).to_numpy()
    rate = first.copy()
    nx, nw, m = (table[c].to_numpy(float) for c in ("nx", "nw", "m"))
    for _ in range(30):
        share = misread_share(nx, nw * (rate / many)[which], chance)
        rate = np.clip((np.bincount(which, share * m * nx, len(ops)) + 0.1 * UNMET) / (base + 0.1), 1e-9, 0.2)
    return dict(zip(ops, (rate / many).tolist(), strict=True))


def _costs(pairs: DataFrame, channel: dict[str, float]) -> DataFrame:
    """Pairs with their cost: the negative log probability of reading w as x."""
    known = F.create_map(*(F.lit(v) for op, p in channel.items() for v in (op, -math.log(p)))) if channel else F.create_map(F.lit(""), F.lit(0.0))
    unknown = -math.log(UNMET)
    cost = F.aggregate("ops", F.lit(math.log(AGAIN)), lambda a, op: a + F.coalesce(F.element_at(known, op), F.lit(unknown)) - math.log(AGAIN))
    return pairs.withColumn("cost", cost)


def _words(counts: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float], int]:
    """Words (word, n, real, neighbours), bigrams (prev, word, n), the channel and the number of words in the corpus."""
    types = counts.where("prev is null").select("word", "n")
    bigrams = counts.where("prev is not null")
    pairs = materialise(_pairs(types), "pairs")
    channel = _channel(pairs, types)
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    costed = materialise(_costs(pairs, channel), "costed")
    # what stands before x, as it would if x were w (its own occurrence left out), against its own company
    asked = costed.where("nx >= 4").withColumn("r", F.max_by("w", F.log("nw") - F.col("cost")).over(_window("x"))).where("w = r").select("x", "w", "nx", "nw")
    company = asked.join(bigrams.select(F.col("word").alias("x"), "prev", F.col("n").alias("nbx")), "x").join(bigrams.select(F.col("word").alias("w"), "prev", F.col("n").alias("nbw")), ["w", "prev"], "left").join(types.select(F.col("word").alias("prev"), F.col("n").alias("nb")), "prev")
    by_chance = F.col("nb") / max(1, total)
    ratio = F.log((F.col("nbx") - 1) / (F.col("nx") - 1) + by_chance) - F.log(F.coalesce("nbw", F.lit(0)) / F.col("nw") + by_chance)
    company = company.withColumn("ratio", ratio)
    # what speaks for a word of its own counts beyond three standard deviations and beyond 1.5 an occurrence: some places in a line are misread more often
    told = F.sum(F.col("nbx") * F.col("ratio"))
    noise = F.greatest(3 * F.sqrt(F.sum(F.col("nbx") * F.col("ratio") * F.col("ratio"))), 1.5 * F.sum("nbx"))
    evidence = company.groupBy("x").agg(F.when(told > 0, F.greatest(told - noise, F.lit(0.0))).otherwise(told).alias("evidence"))
    expected = F.log(F.sum(F.col("nw") * F.exp(-F.col("cost"))))
    n, e = F.col("nx"), F.col("log_expected")
    more = F.log1p(F.exp(e))
    odd = F.rlike("x", F.lit(r"[0-9@|!]")).cast("int") * math.log(1e-3)
    odds = F.log("chance") + odd - F.log(n) - F.log(n + 1.0) + more - n * (e - more) - (F.col("least_ops") - 1) * math.log(AGAIN) + F.coalesce("evidence", F.lit(0.0))
    real = costed.groupBy("x", "nx").agg(expected.alias("log_expected"), F.min(F.size("ops")).alias("least_ops"), F.min(F.when(F.col("stroke"), REAL[True]).otherwise(REAL[False])).alias("chance")).join(evidence, "x", "left")
    real = materialise(real.select(F.col("x").alias("word"), (1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))).alias("real")), "real")
    # neighbours that are words of their own, in both directions for words of the same strokes, where they could ever be the cheaper reading
    back = costed.where("stroke").select(F.col("w").alias("x"), F.col("nw").alias("nx"), F.col("x").alias("w"), F.col("nx").alias("nw"), "cost")
    both = costed.select("x", "nx", "w", "nw", "cost").unionByName(back)
    sure = both.join(real.where("real < 0.5").select(F.col("word").alias("w")), "w", "left_anti").join(real.select(F.col("word").alias("x"), "real"), "x", "left")
    reach = 5 - F.log(0.3 * (F.col("nx") * F.coalesce("real", F.lit(1.0)) + 0.01) / max(1, total))
    near = sure.where(F.col("cost") <= reach).groupBy("x").agg(F.array_sort(F.collect_list(F.struct("w", "cost"))).alias("neighbours"))
    words = types.join(real, "word", "left").join(near.withColumnRenamed("x", "word"), "word", "left")
    return materialise(words.select("word", "n", F.coalesce("real", F.lit(1.0)).alias("real"), "neighbours"), "words"), bigrams, channel, total


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _lexicon(words: pd.DataFrame, bigrams: pd.DataFrame, channel: dict[str, float], total: int) -> Lexicon:
    counts = dict(zip(words["word"], words["n"].astype(int), strict=True))
    real = {w: r for w, r in zip(words["word"], words["real"], strict=True) if r < 1 - 1e-9}
    neighbours = {w: [(x["w"], x["cost"]) for x in xs] for w, xs in zip(words["word"], words["neighbours"], strict=True) if xs is not None and len(xs)}
    stroked: dict[str, list[str]] = defaultdict(list)
    for w in words["word"]:
        if real.get(w, 1.0) >= 0.5:
            stroked[strokes(w)].append(w)
    keys = bigrams["key"].to_numpy(np.int64)
    order = np.argsort(keys)
    return Lexicon(total, counts, real, neighbours, dict(stroked), (keys[order], bigrams["n"].to_numpy(np.int32)[order]), channel)


def scan_pages(df: DataFrame) -> DataFrame:
    """One row a page with text: stable_id, page_num, lines (array of line_no and kind), repaired."""
    spark = df.sparkSession
    read = materialise(_read(df), "read")
    pages = read.where("stable_id is not null").select(*(c.split()[0] for c in PAGE.split(", ")))
    counts = materialise(read.where("word is not null").groupBy("prev", "word").agg(F.sum("n").alias("n")), "counts")
    words, bigrams, channel, total = _words(counts)
    # a bigram that comes once tells nothing when its own occurrence is left out
    keyed = bigrams.where("n > 1").select(F.xxhash64(F.concat_ws(" ", "prev", "word")).alias("key"), "n")
    if words.count() + keyed.count() > LEXICON_ROWS:
        return _local(pages, words, keyed, channel, total)
    lexicon = spark.sparkContext.broadcast(_lexicon(words.toPandas(), keyed.toPandas(), channel, total))
    return _repaired(pages, lambda: lexicon.value)


REPAIRED = "stable_id string, page_num long, lines array<struct<line_no:int,kind:string>>, repaired string"


def _repaired(pages: DataFrame, lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon()
        for batch in batches:
            lines, texts = [], []
            for text, flags, kinds, after, before in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                found, repaired = repair(text, dict(zip(flags, kinds, strict=True)), lex, after, before)
                lines.append([{"line_no": no, "kind": kind} for no, kind in found])
                texts.append(repaired)
            kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lines, kind), pa.array(texts, pa.string())], names=["stable_id", "page_num", "lines", "repaired"])

    return pages.mapInArrow(run, REPAIRED).withColumn("page_num", F.col("page_num").cast("int"))


def _bodies(text: str, flags: list[int]) -> list[list[str]]:
    return [tokens(line) for i, line in enumerate(text.split("\n"), 1) if line.strip() and i not in flags]


def _asked(text: str, flags: list[int], after: str | None, before: str | None) -> set[str]:
    """Every word that the repair of a page may look up."""
    out: set[str] = set()
    lines = _bodies(text, flags)
    for toks in lines:
        for t in toks:
            low = _low(t)
            out.update((low, *low.split("-")))
    ends = [toks[-1] for toks in lines] + ([before] if before else [])
    begins = [toks[0] for toks in lines[1:]] + ([after] if after else []) + [toks[0] for toks in lines[:1]]
    pairs = list(zip(ends, begins[: len(lines) - 1] + ([after] if after else [""]), strict=False)) + ([(before, lines[0][0])] if before and lines else [])
    for left, right in pairs:
        stem = broken(left)
        if stem and right:
            a, b = core_of(stem)[1].lower().lstrip(OUTER), core_of(right)[1].lower()
            last = a.rpartition("-")[2] or a
            out.update((a, b, last, a + b, f"{a}-{b}", last + b))
    out.discard("")
    return out


def _pairs_asked(text: str, flags: list[int], lex: Lexicon) -> set[int]:
    """Keys of every bigram that the repair of a page may look up."""
    out: set[int] = set()
    for toks in _bodies(text, flags):
        seen = [lex.token(t) for t in toks]
        spoken = [t[3] for t in seen if t[4]]
        around = [(seen[k - 1][3], seen[k + 1][3]) for k in range(1, len(toks) - 1) if toks[k] in ("-", "–")]
        for x, y in [*zip(spoken, spoken[1:], strict=False), *around]:
            if x in lex.neighbours or y in lex.neighbours or around:
                out.update(bigram_key(a, b) for a, _ in lex.options(x) for b, _ in lex.options(y))
    return out


def _local(pages: DataFrame, words: DataFrame, keyed: DataFrame, channel: dict[str, float], total: int) -> DataFrame:
    """The repair of pages whose share of the statistics is joined to them, some SHARE pages at a time."""
    shares = math.ceil(pages.count() / SHARE)
    placed = materialise(pages.withColumn("share", F.pmod(F.xxhash64("stable_id", F.floor(F.col("page_num") / 16)), F.lit(shares)).cast("int")), "placed")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(share, w) for share, text, flags, after, before in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in _asked(text, flags, after, before)}
            share, word = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(share, pa.int32()), pa.array(word, pa.string()), pa.array(map(strokes, word), pa.string())], names=["share", "word", "stroked"])

    @F.pandas_udf("string")
    def stroked(word: pd.Series) -> pd.Series:
        return word.map(strokes)

    asked = materialise(placed.select("share", "text", "flags", "after", "before").mapInArrow(ask, "share int, word string, stroked string").distinct(), "asked")
    known = asked.select("share", "word").join(words, "word")
    others = known.select("share", F.explode("neighbours").alias("x")).select("share", F.col("x.w").alias("word"))
    unknown = asked.join(words.select("word"), "word", "left_anti").join(words.where("real >= 0.5").select(F.col("word").alias("w"), stroked("word").alias("stroked")), "stroked").select("share", F.col("w").alias("word"))
    more = others.unionByName(unknown).distinct().join(asked.select("share", "word"), ["share", "word"], "left_anti").join(words, "word")
    # neighbours of neighbours aren't looked up
    rows = known.unionByName(more.withColumn("neighbours", F.lit(None).cast(words.schema["neighbours"].dataType)).select(*known.columns))
    rows = materialise(rows.select("share", "word", "n", "real", "neighbours", F.lit(None).cast("long").alias("key")), "share_words")

    def lexicon(pdf: pd.DataFrame) -> Lexicon:
        return _lexicon(pdf[pdf["word"].notna()], pdf[pdf["word"].isna()], channel, total)

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lex, keys = lexicon(right), set()
        for text, flags in zip(left["text"], left["flags"], strict=True):
            keys |= _pairs_asked(text, list(flags), lex)
        return pd.DataFrame({"share": left["share"].iloc[:1].repeat(len(keys)).to_numpy(), "key": np.array(list(keys), np.int64)}) if len(left) else pd.DataFrame({"share": [], "key": []})

    wanted = placed.groupBy("share").cogroup(rows.groupBy("share")).applyInPandas(pairs, "share int, key long")
    none = F.lit(None)
    numbers = wanted.join(keyed, "key").select("share", none.cast("string").alias("word"), "n", none.cast("double").alias("real"), none.cast(words.schema["neighbours"].dataType).alias("neighbours"), "key")
    every = rows.unionByName(numbers)

    def mend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lex, out = lexicon(right), []
        for r in left.itertuples():
            found, repaired = repair(r.text, dict(zip(r.flags, r.kinds, strict=True)), lex, r.after, r.before)
            out.append((r.stable_id, r.page_num, [{"line_no": no, "kind": kind} for no, kind in found], repaired))
        return pd.DataFrame(out, columns=["stable_id", "page_num", "lines", "repaired"])

    done = placed.groupBy("share").cogroup(every.groupBy("share")).applyInPandas(mend, REPAIRED)
    return done.withColumn("page_num", F.col("page_num").cast("int"))


def scan_lines(df: DataFrame) -> DataFrame:
    """stable_id, page_num, line_no, kind of every line that is running, page_number, hyphen or misread."""
    return scan_pages(df).select("stable_id", "page_num", F.explode("lines").alias("x")).select("stable_id", "page_num", "x.line_no", "x.kind")
