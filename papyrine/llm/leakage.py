"""Evaluation texts leaking into training text: template canonicalisation.

Texts are brought to words (markup, entities, ligatures, case, punctuation, spacing and hyphens
disregarded). In the canonical form numbers, names and units are typed placeholders, so that a
question with other values has the same template. Windows of five words, in canonical form and as
plain lower-case words (so that a passage in capitals, whose words look like names, is met as well),
are hashed, and the windows of the documents are joined with those of the items by their hash.
Documents and items with enough windows in common are aligned word by word:

* by words: the longest stretch of the item with at most one word in eight exchanged;
* by template, where the words do not fit: the same with slots of one type counted as equal, and the values of
  the slots compared; only if they differ consistently (one value always for the same other one), the
  stretch is reported as re-parameterised, however many values were changed.

If at most one word in eight of a stretch of L >= 20 words is exchanged, five words in a row are
equal somewhere, so the windows lose no such stretch.

Documents are read twice, once for their windows and once for the texts of candidates; only windows
that pass a filter of fixed size made from those of the items, and the texts of candidates, are
shuffled. The windows of the items are broadcast after a count, and shuffled if there are many.

Defined results: null and empty texts match nothing; repeated rows give one result; an empty table
gives an empty result; items of fewer than five words have no window and are left
out; ties go to the stretch that begins first; whole texts are searched, however long.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import bits, in_bits
from papyrine.session import small, stored

WINDOW = 5
#: At least this part of an item, with at most this part of the words exchanged.
LEAST_PART, EXCHANGED = 0.4, 1 / 8
#: Windows of items are broadcast up to this number (some 60 MB).
BROADCAST_WINDOWS = 1_000_000
#: How far an alignment may leave its diagonal (words inserted or lost by broken words).
DRIFT = 3
#: Words that stand for units after a number (fixed values).
UNITS = frozenset("percent mg milligrams milligram g kg ug mcg ml l dl mm cm m km mmol mol min minutes minute hours hour days day weeks week months month years year times".split())
FOUND = "doc_id long, item_id long, matched_words int, item_words int, part double, exchanged int, slots_changed int, consistent boolean, kind string, by string"

_TAG = re.compile(r"<[^<>]{0,300}>")
_BREAK = re.compile(r"(?<=\w)[-‐‑­]\s*\n\s*(?=\w)")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑‒–­'’](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> tuple[list[str], list[str]]:
    """Words and canonical words (typed placeholders) of a text."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _HYPHEN.sub("", _BREAK.sub("", text))
    raw = _WORD.findall(text)
    upper = sum(w.isupper() for w in raw) * 2 > len(raw)  # a text in capitals has no names by case
    words, canon = [], []
    for w in raw:
        low = w.lower()
        if low[0].isdigit():
            c = "\x01n"
        elif not low.isalpha() or (w.isupper() and len(w) > 2 and not upper):
            c = "\x01id"
        elif low in UNITS and canon and canon[-1] == "\x01n":
            c = "\x01u"
        else:
            c = low
        words.append(low)
        canon.append(c)
    return words, canon


class ItemIndex:
    """Hash table of the windows of items, as templates and as plain words."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.windows: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        self.codes: dict[str, int] = {}
        self.items: list[np.ndarray] = []
        self.templates: list[np.ndarray] = []
        self.slots: list[np.ndarray] = []
        for k, (_, text) in enumerate(items):
            words, canon = tokens(text or "")
            self.items.append(np.array([self.codes.setdefault(w, len(self.codes)) for w in words], dtype=np.int64))
            self.templates.append(np.array([self.codes.setdefault(w, len(self.codes)) for w in canon], dtype=np.int64))
            self.slots.append(np.array([c[0] == "\x01" for c in canon], dtype=bool))
            for i in range(len(canon) - WINDOW + 1):
                for window in {tuple(canon[i : i + WINDOW]), tuple(words[i : i + WINDOW])}:
                    self.windows.setdefault(window, []).append((k, i))

    def search(self, text: str) -> list[tuple]:
        words, canon = tokens(text)
        get = self.windows.get
        hits: dict[int, set[tuple[int, int]]] = {}
        for form in (canon, words):  # one place found in both forms is one hit
            for i, window in enumerate(zip(form, form[1:], form[2:], form[3:], form[4:], strict=False)):
                at = get(window)
                if at:
                    for k, j in at:
                        hits.setdefault(k, set()).add((i - j, j))
        if not hits:
            return []
        code = self.codes.get
        coded = np.array([code(w, -1) for w in words], dtype=np.int64)
        # a word that no item has is told from others by its own text
        values = np.array([code(w) if w in self.codes else -2 - hash(w) % (1 << 60) for w in words], dtype=np.int64)
        shapes = np.array([code(w, -1) for w in canon], dtype=np.int64)
        out = []
        for k, pairs in hits.items():
            need = least_windows(len(self.items[k]))
            if len(pairs) < need:
                continue
            diagonals = self._diagonals(pairs, need)
            for by, item, text in (("words", self.items[k], coded), ("template", self.templates[k], shapes)):
                best = None
                for d in diagonals:
                    found = self._align(k, item, text, values, d)
                    if found and by == "template":
                        found = (*found[:-1], "reparameterised") if found[4] and found[5] else None
                    if found and (best is None or found[0] > best[0]):
                        best = found
                if best:
                    out.append((self.ids[k], *best, by))
                    break
        return out

    @staticmethod
    def _diagonals(pairs: set[tuple[int, int]], need: int) -> list[int]:
        """Diagonals whose band holds enough windows; the fullest of each neighbourhood."""
        count: dict[int, int] = {}
        for d, _ in pairs:
            count[d] = count.get(d, 0) + 1
        full = sorted((d for d in count if sum(count.get(d + e, 0) for e in range(-DRIFT, DRIFT + 1)) >= need), key=lambda d: (-count[d], d))
        taken: list[int] = []
        for d in full:
            if all(abs(d - t) > DRIFT for t in taken):
                taken.append(d)
        return taken

    def _align(self, k: int, item: np.ndarray, coded: np.ndarray, values: np.ndarray, d: int) -> tuple | None:
        """The longest stretch of item k along diagonal d with few enough exchanged words, or template words."""
        n = len(item)
        hit = np.zeros(n, dtype=bool)
        where = np.full(n, -1, dtype=np.int64)
        order = sorted(range(-DRIFT, DRIFT + 1), key=abs)
        for e in order:
            at = np.arange(n) + d + e
            ok = (at >= 0) & (at < len(coded))
            same = np.zeros(n, dtype=bool)
            same[ok] = coded[at[ok]] == item[ok]
            beside = np.zeros(n, dtype=bool)
            beside[1:] |= same[:-1]
            beside[:-1] |= same[1:]
            same &= beside  # a lone equal word off the path is chance
            new = same & ~hit
            where[new] = at[new]
            hit |= same
        spots = np.flatnonzero(hit)
        if len(spots) == 0 or len(spots) < LEAST_PART * n * (1 - EXCHANGED):
            return None
        # longest [i, j] of matched ends with exchanged <= EXCHANGED * length
        level = np.arange(1, len(spots) + 1)
        length = spots[None, :] - spots[:, None] + 1
        matched = level[None, :] - level[:, None] + 1
        fits = (length > 0) & (length - matched <= EXCHANGED * length)
        length = np.where(fits, length, 0)
        best = int(length.argmax())
        i, j = divmod(best, len(spots))
        size = int(length[i, j])
        if size < LEAST_PART * n:
            return None
        lo, hi = spots[i], spots[j]
        slots = self.slots[k][lo : hi + 1]
        gap = ~hit[lo : hi + 1]
        base = where[lo : hi + 1].copy()
        for x in range(1, len(base)):  # an exchanged word stands after the one before it
            if base[x] < 0:
                base[x] = base[x - 1] + 1
        own = self.items[k]
        mapping: dict[int, int] = {}
        consistent, changed = True, 0
        for x in np.flatnonzero(slots):
            value = int(values[base[x]]) if base[x] < len(values) else -1
            changed += value != own[lo + x]
            if mapping.setdefault(int(own[lo + x]), value) != value:
                consistent = False
        other = int((gap & ~slots).sum())
        exchanged = other + changed
        kind = "exact" if not exchanged else "reparameterised" if changed and not other and consistent else "exchanged"
        return size, n, round(size / n, 4), exchanged, changed, consistent, kind


def least_windows(n: int) -> int:
    """Windows in common at least: a stretch of L words with L/8 exchanged has at least 3L/8 - 4 clean ones."""
    return max(1, int(0.375 * LEAST_PART * n - 4))


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)
_MOST_SEEN = 200_000


class _Codes(dict):
    """Words as numbers, each hashed once while there is room."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > _MOST_SEEN:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_codes = _Codes()


def _window_hashes(words: list[str]) -> np.ndarray:
    """The hash of every window."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        out += codes[k : k + n] * _POWERS[k]
    out ^= out >> np.uint64(29)
    return (out * _POWERS[0]).view(np.int64)


def _both(text: str) -> np.ndarray:
    """The hashes of a text's windows in both forms; a window without slots counts once."""
    words, canon = tokens(text)
    plain, shape = _window_hashes(words), _window_hashes(canon)
    return np.concatenate([plain, shape[shape != plain]])


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, d, int(h), least_windows(len(tokens(t)[0]))) for i, d, t in zip(b["item_id"], b["item_digest"], b["text"], strict=True) for h in np.unique(_both(t))]
        yield pd.DataFrame(rows, columns=["item_id", "item_digest", "window", "need"])


def _document_windows(mask: object) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for text in b["text"]:
                h = _both(text)
                found.append(h[in_bits(mask.value, h)])
            at = np.repeat(np.arange(len(b)), [len(h) for h in found])
            yield b[["doc_id", "digest"]].iloc[at].assign(window=np.concatenate(found) if found else np.empty(0, dtype=np.int64))

    return run


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in FOUND.split(", ")]
    known: dict[str, ItemIndex] = {}
    for b in batches:
        rows = []
        for doc, text, item, wanted in zip(b["doc_id"], b["text"], b["item_id"], b["item_text"], strict=True):
            if wanted not in known:
                if len(known) >= 1000:
                    known.clear()
                known[wanted] = ItemIndex([(0, wanted)])
            rows += [(doc, item, *m[1:]) for m in known[wanted].search(text)]
        yield pd.DataFrame(rows, columns=names)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Schema FOUND: every document and item where enough of the item, or of its template with other values, stands in the document."""
    spark = documents.sparkSession
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text").withColumn("digest", F.xxhash64("text"))
    listed = items.where("item_id is not null and text is not null").select("item_id", "text").distinct().withColumn("item_digest", F.xxhash64("text"))
    windows = stored(listed.mapInPandas(_item_windows, "item_id long, item_digest long, window long, need int"), "windows")
    mask = spark.sparkContext.broadcast(bits(windows, "window"))
    asked = texts.mapInPandas(_document_windows(mask), "doc_id long, digest long, window long")
    few = F.broadcast(windows) if small(windows, BROADCAST_WINDOWS) else windows
    # a window that occurs in a document, or an item, several times counts as often: more candidates, never fewer
    hits = asked.join(few, "window").groupBy("doc_id", "digest", "item_id", "item_digest").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    pairs = stored(hits.where("n >= need").select("doc_id", "digest", "item_id", "item_digest"), "candidates")
    both = texts.distinct().join(pairs, ["doc_id", "digest"]).join(listed.withColumnRenamed("text", "item_text"), ["item_id", "item_digest"])
    return both.select("doc_id", "text", "item_id", "item_text").mapInPandas(_verified, FOUND).distinct()
