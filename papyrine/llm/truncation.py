"""Text cut off by field limits: near-copies whose alignment ends early, and closing-word terminality.

1. Exact copies are judged once. Near-copies are found by min-hash banding over five-word shingles:
   of whole texts (similarity 0.8 or more), and, because a cut copy may be much shorter than the
   whole one, of beginnings. Beginnings of 24, 48, 96, ... shingles of every text are banded; a text
   with an open end asks with its longest for the texts that go on (0.8 of its shingles in the other).
   Both are verified on the shingle sets and aligned; if a text ends where its copy goes on, in a
   word or sentence, it was cut.
2. Texts without such a copy are judged by their last words. For the last three, two and one words
   (numbers and names typed) the corpus tells how often a line ends there without a stop, leaving
   the text itself out. Words that seldom end a line are cuts; a last word that the corpus knows
   only as the beginning of another word after the same neighbour is cut inside.
   Marks put there by a cut (an ellipsis, "[...]", "(more)") are taken off first. Only contexts that
   some open end asks for pass a filter of fixed size and are shuffled.

Defined results: null, empty and placeholder texts are no cuts; a text ending in a full stop,
question or exclamation mark, closing quote or tag is whole unless a copy shows otherwise; repeated
rows give one result; an empty table gives an empty result; null sources are reported as null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import BITS, asked, bits, in_bits, met  # noqa: F401
from papyrine.session import stored

SHINGLE, SIMILAR = 5, 0.8
#: 16 bands of 4 hashes: a pair of similarity 0.8 is missed once in 5,000 times.
BANDS, BAND_ROWS = 16, 4
#: Beginnings: shingles of the shortest, and 6 bands of 3 hashes for each, which miss a pair of similarity 0.8 once in 75 times.
BEGINNING, BEGINNING_BANDS, BEGINNING_ROWS = 24, 6, 3
#: Texts sketched at once.
TEXTS = 256
#: Buckets of more texts are compared in parts.
BUCKET = 200
#: Below this share of line ends among its occurrences a closing context tells a cut; at least so many occurrences.
#: A mark put there by a cut is believed unless the context ends lines more often than MARKED.
TERMINAL, LEAST_SEEN, MARKED = 0.2, 3, 0.5
#: Sentences that begin alike are bare lines if this share of them ends a line without a stop.
BARE = 0.5
#: A last word is cut inside if a longer word after the same neighbour is so many times as frequent.
LONGER = 5

_MARK = re.compile(r"\s*(?:[\[(]\s*(?:\.{3}|…|more|trunc\w*|cut|continued)?\s*[\])]?|…|\.{3,})\s*$", re.I)
_STOP = re.compile(r"(?:[.!?][\"'”’»)\]]*|[\"”»>])$")
_PLACEHOLDER = re.compile(r"^\W*(?:n/?a|none|null|nil|tbd|pending|no (?:text|abstract|content)(?: available)?|(?:text|abstract|content) not available|not available)?\W*$", re.I)
#: A hyphen at the end of a line belongs to its word: what follows it is missing.
_TOKEN = re.compile(r"\w+(?:[-./]\w+)*(?:(?<=[^\W\d_])-(?=\s*$))?|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+(?=[^a-z\s])")
_WORD = re.compile(r"[^\W_]+")
_NEXT_LINE = re.compile(r"^\s*[^a-z\s]")


def typed(token: str) -> str:
    """A token with numbers and names replaced by their type."""
    if token[0].isdigit():
        return "#"
    if len(token) > 1 and (token.isupper() or any(c.isdigit() for c in token)):
        return "@"
    return token.lower()


def _lone(token: str) -> bool:
    """Whether a token is a single capital: inside a sentence a name, or the beginning of one."""
    return len(token) == 1 and token.isupper()


def typed_unit(unit: list[str]) -> list[str]:
    """The tokens of a sentence, typed."""
    return ["@" if i and _lone(t) else typed(t) for i, t in enumerate(unit)]


def _tail(text: str) -> tuple[str, bool]:
    """The text without outer space and marks of a cut, and whether there was a mark."""
    bare = text.strip()
    at = max(bare.rfind("["), bare.rfind("("))  # no mark has a second one, so the text is not searched
    if at >= 0 and _MARK.match(bare, at):
        return bare[:at].rstrip(), True
    cut = bare[:-1] if bare.endswith("…") else bare.rstrip(".") if bare.endswith("...") else bare
    return cut.rstrip(), cut != bare


def closing(text: str) -> tuple[str, str, str, str, str, str]:
    """(state, c3, c2, c1, start, last): state is empty, whole, stopped (a mark after a stop), marked or open; the rest for the last three states.

    `last` is the last word in lower case, but a single capital that is typed a name.
    """
    if _PLACEHOLDER.match(text):
        return ("empty", "", "", "", "", "")
    bare, marked = _tail(text)
    if not bare or _PLACEHOLDER.match(bare):
        return ("empty", "", "", "", "", "")
    if _STOP.search(bare) and not marked:
        return ("whole", "", "", "", "", "")
    before, last = ([], *units(bare.rsplit("\n", 1)[-1]))[-2:]
    if not last:
        return ("whole", "", "", "", "", "")
    unit = typed_unit(last)
    c3, c2, c1 = list(contexts(typed_unit(before), unit))[-1]
    word = last[-1] if len(last) > 1 and _lone(last[-1]) else last[-1].lower()
    return ("stopped" if _STOP.search(bare) else "marked" if marked else "open", c3, c2, c1, begins(unit), word)


def begins(unit: list[str]) -> str:
    """How a sentence begins: its first two tokens."""
    return "\x03" + " ".join(unit[:2])


def units(line: str) -> list[list[str]]:
    """The tokens of every sentence of a line."""
    out = [_TOKEN.findall(sentence) for sentence in _SENTENCE.split(line)]
    return [x for x in out if x] or [[]]


def contexts(before: list[str], unit: list[str]) -> Iterator[tuple[str, str, str]]:
    """For every token of a sentence its contexts of three, two and one words, "what precedes\\x02the word".

    The first word of a sentence is preceded by the last two tokens of the sentence before it in the line.
    """
    start = " ".join([*before[-2:], "^"])
    for i, t in enumerate(unit):
        if i == 0:
            yield f"{start}\x02{t}", f"{start}\x02{t}", t
        else:
            yield f"{unit[i - 2] if i > 1 else '^'} {unit[i - 1]}\x02{t}", f"{unit[i - 1]}\x02{t}", t


def code(context: str) -> int:
    """A context as a number, for the filter."""
    import xxhash

    return xxhash.xxh64_intdigest(context) - (1 << 63)


SCANNED = "digest string, state string, c3 string, c2 string, c1 string, start string, last string, asks array<long>, grams long, bands array<long>, beginnings array<long>, longest array<long>"


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every text its end, the contexts it asks for, and the bands of the whole and of its beginnings."""
    for b in batches:
        rows = []
        sketch = [x for at in range(0, len(b), TEXTS) for x in sketched(b["text"].iloc[at : at + TEXTS].tolist())]
        for digest, text, (grams, whole, beginnings, longest) in zip(b["digest"], b["text"], sketch, strict=True):
            end = closing(text)
            c3, c2, c1, start = end[1:5]
            asks = [code(c) for c in (c3, c2, c1, start)] + [code(c.split("\x02")[0] + "\x02") for c in (c3, c2) if "\x02" in c] if end[0] in ("open", "marked") else []
            rows.append((digest, *end, asks, grams, whole, beginnings, longest if end[0] in ("open", "marked", "stopped") else []))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")])


def _counter(mask: object) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts of contexts of one to three words, all occurrences and those that end a line without a stop, for the contexts of the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        types: dict[str, str] = {}
        for b in batches:
            one: Counter[str] = Counter()
            two: Counter[tuple[str, str]] = Counter()
            three: Counter[tuple[str, str, str]] = Counter()
            ended: Counter[str] = Counter()
            for text in b["text"]:
                bare, _ = _tail(text)
                lines = bare.split("\n")
                for k, line in enumerate(lines):
                    before: list[str] = []
                    unit: list[str] = []
                    earlier: list[str] = []
                    for toks in units(line):
                        if not toks:
                            continue
                        earlier = before
                        unit = []
                        for t in toks:
                            x = types.get(t)
                            if x is None:
                                if len(types) > 200_000:
                                    types.clear()
                                x = types[t] = "@" if _lone(t) else typed(t)
                            unit.append(x)
                        if _lone(toks[0]):
                            unit[0] = typed(toks[0])
                        one.update(unit)
                        one[begins(unit)] += 1
                        two[" ".join([*before[-2:], "^"]), unit[0]] += 1
                        if len(unit) > 1:
                            two.update(zip(unit, unit[1:], strict=False))
                            three["^", unit[0], unit[1]] += 1
                            three.update(zip(unit, unit[1:], unit[2:], strict=False))
                        before = unit
                    if unit and not _STOP.search(line.rstrip()):
                        after = next((x for x in lines[k + 1 :] if x.strip()), None)
                        if after is None or _NEXT_LINE.match(after):
                            ended.update(set(list(contexts(earlier, unit))[-1]))
                            ended[begins(unit)] += 1
            seen = Counter(one)
            for (x, y), n in two.items():
                seen[f"{x}\x02{y}"] += n
            for (x, y, z), n in three.items():
                seen[f"{x} {y}\x02{z}"] += n
            keys = list(seen)
            passed = in_bits(mask.value, np.array([code(k) for k in keys], dtype=np.int64))
            passed |= in_bits(mask.value, np.array([code(k.split("\x02")[0] + "\x02") if "\x02" in k else 0 for k in keys], dtype=np.int64)) & np.array(["\x02" in k for k in keys], dtype=bool)
            keys = [k for k, ok in zip(keys, passed, strict=True) if ok]
            yield pd.DataFrame({"context": keys, "n": [seen[k] for k in keys], "n_end": [ended.get(k, 0) for k in keys]})

    return run


_RNG = np.random.default_rng(11)
_A = _RNG.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


_MIX = np.uint64(0x9E3779B97F4A7C15)
_codes: dict[str, int] = {}


def _coded(words: list[str]) -> list[int]:
    import xxhash

    if len(_codes) > 200_000:
        _codes.clear()
    for w in words:
        if w not in _codes:
            _codes[w] = xxhash.xxh64_intdigest(w)
    return [_codes[w] for w in words]


def _shingled(h: np.ndarray) -> np.ndarray:
    """The 32-bit hash of every run of five words, from the hashes of the words."""
    n = max(0, len(h) - SHINGLE + 1)
    out = h[:n].copy()
    for i in range(1, SHINGLE):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += h[i : n + i]
    out *= _MIX
    return out >> np.uint64(32)


def grams(text: str) -> np.ndarray:
    """The 32-bit hashes of the five-word shingles of a text, in order."""
    return _shingled(np.array(_coded(_WORD.findall(text.lower())), dtype=np.uint64))


def shingles(text: str) -> np.ndarray:
    """Their distinct values."""
    return np.unique(grams(text))


def _banded(low: np.ndarray, rows: int, mark: np.ndarray) -> list[list[int]]:
    """The bands of each row of lowest hashes; `mark` tells kinds of rows apart."""
    low = low.reshape(len(low), -1, rows)
    out = (mark[:, None].astype(np.uint64) * np.uint64(64) + np.arange(1, low.shape[1] + 1, dtype=np.uint64)[None, :]) * _MIX
    for i in range(rows):
        out = (out ^ (out >> np.uint64(29)) ^ low[:, :, i]) * _MIX
    return (out ^ (out >> np.uint64(32))).view(np.int64).tolist()


def sketched(texts: list[str]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """(distinct shingles, bands of the whole, bands of all beginnings, bands of the longest one) of every text, in one pass."""
    words = [_WORD.findall(t.lower()) for t in texts]
    h = np.array([x for w in words for x in _coded(w)], dtype=np.uint64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    n = np.maximum(size - SHINGLE + 1, 0)
    begin = np.cumsum(n) - n
    # the shingles inside one text, texts one after the other
    s = _shingled(h)[np.repeat(np.cumsum(size) - size - begin, n) + np.arange(n.sum())]
    out: list[tuple[int, list[int], list[int], list[int]]] = [(0, [], [], [])] * len(texts)
    if not len(s):
        return out
    # a stretch for each beginning, from the end of the one before, and one for the rest
    at: list[int] = []
    level: list[int] = []
    firsts: list[int] = []
    some = np.flatnonzero(n)
    for i in some:
        firsts.append(len(at))
        done, to, k = 0, BEGINNING, 0
        while to <= n[i]:
            at.append(begin[i] + done)
            level.append(k)
            done, to, k = to, to * 2, k + 1
        if done < n[i]:
            at.append(begin[i] + done)
            level.append(-1)
    low = np.empty((len(at), BANDS * BAND_ROWS), dtype=np.uint64)
    for k in range(low.shape[1]):
        low[:, k] = np.minimum.reduceat((s * _A[k] + _B[k]) >> np.uint64(32), at)
    whole = _banded(np.minimum.reduceat(low, firsts, axis=0), BAND_ROWS, np.zeros(len(some)))
    of, depth = low[:, : BEGINNING_BANDS * BEGINNING_ROWS], np.array(level)
    for k in range(1, depth.max() + 1):
        mine = np.flatnonzero(depth == k)
        of[mine] = np.minimum(of[mine], of[mine - 1])
    bands = _banded(np.ascontiguousarray(of), BEGINNING_ROWS, np.maximum(depth, 0) + 1000)
    distinct = np.bincount((np.unique((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | s) >> np.uint64(32)).astype(np.int64), minlength=len(n))
    for j, i in enumerate(some):
        own = [bands[x] for x in range(firsts[j], firsts[j + 1] if j + 1 < len(firsts) else len(at)) if level[x] >= 0]
        out[i] = (int(distinct[i]), whole[j], [x for y in own for x in y], own[-1] if own else [])
    return out


def sketches(text: str) -> tuple[int, list[int], list[int], list[int]]:
    """sketched() of one text."""
    return sketched([text])[0]


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pairs of texts those that are similar, and for each of the two whether it ends early inside a sentence of the other."""
    known: dict[str, np.ndarray] = {}

    def of(digest: str, text: str) -> np.ndarray:
        if digest not in known:
            if len(known) >= TEXTS:
                known.clear()
            known[digest] = shingles(text)
        return known[digest]

    for b in batches:
        out = []
        for a, one, c, other in zip(b["a"], b["text_a"], b["b"], b["text_b"], strict=True):
            x, y = of(a, one), of(c, other)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= SIMILAR * max(1, min(len(x), len(y))):  # similar as wholes, or the shorter one in the longer
                out += [(a, ends_early(one, other)), (c, ends_early(other, one))]
        yield pd.DataFrame(out, columns=["digest", "early"])


def ends_early(short: str, long: str) -> bool:
    """Whether `long` goes on, inside a word or sentence, where `short` ends.

    The alignment is anchored at the last complete words of `short`: the same run of words in `long`
    nearest to the same place, what follows there compared with the last word of `short`.
    """
    bare, _ = _tail(short)
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", bare.lower())]
    if len(words) < 6 or _PLACEHOLDER.match(bare):
        return False
    target = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", long.lower())]
    anchor, last = [w for w, _, _ in words[-6:-1]], words[-1][0]
    spots = [i for i in range(len(target) - 5) if target[i][0] == anchor[0] and [w for w, _, _ in target[i : i + 5]] == anchor]
    if not spots:
        return False
    i = min(spots, key=lambda s: abs(s - (len(words) - 6))) + 5
    follow, start, end = target[i]
    rest = bare[words[-1][2] :]
    if follow != last:
        return follow.startswith(last) and not rest.strip()  # cut inside the word
    after = long[end:].lstrip("…")
    if not after.strip() or i + 1 >= len(target):
        return False
    if rest.strip():  # the short text has its own end: a stop is a cut only if the copy has a number going on
        return rest.strip() == "." and bool(re.match(r"\.\d", after))
    between = long[end : target[i + 1][1]]
    return "\n" not in between and not re.match(r"\s*[.!?]", between)


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, state, evidence, terminality, cut) for every document."""
    base = documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    ids = base.select("doc_id", "source", "digest")
    texts = stored(base.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts", release=True)

    scanned = stored(texts.select("digest", "text").mapInPandas(_scanned, SCANNED), "scanned")
    ends = scanned.select("digest", "state", "c3", "c2", "c1", "start", "last")

    # 1. near-copies: every two texts of a bucket whose numbers of shingles allow the similarity, and open ends with what begins alike and is longer
    member = F.struct("digest", "grams")
    pairs = met(scanned.select(F.explode("bands").alias("key"), member.alias("member")), BUCKET)
    pairs = pairs.where(F.least("a.grams", "b.grams") >= (SIMILAR - 1e-9) * F.greatest("a.grams", "b.grams"))
    short = scanned.select(F.explode("longest").alias("key"), member.alias("a"))
    pairs = pairs.unionByName(asked(short, scanned.select(F.explode("beginnings").alias("key"), member.alias("b")), BUCKET).where("a.grams < b.grams"))
    pairs = pairs.select(F.least("a.digest", "b.digest").alias("a"), F.greatest("a.digest", "b.digest").alias("b")).distinct()
    pairs = stored(pairs, "pairs", release=True)
    side = lambda s: texts.select(F.col("digest").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "text_a", "b", "text_b")
    copies = both.mapInPandas(_aligned, "digest string, early boolean").groupBy("digest").agg(F.max("early").alias("early"))
    copies = stored(copies, "copies", release=True)

    # 2. terminality of the open ends, from the counts of all texts
    mask = documents.sparkSession.sparkContext.broadcast(bits(scanned.select(F.explode("asks").alias("ask")), "ask"))
    counts = texts.select("text").mapInPandas(_counter(mask), "context string, n long, n_end long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    counts = stored(counts, "contexts", release=True)
    opened = ends.where("state in ('open', 'marked')")
    wanted = opened.select(F.explode(F.array("c3", "c2", "c1", "start")).alias("context")).distinct()
    known = stored(counts.join(wanted, "context", "left_semi"), "contexts")
    e = opened
    for c in ("c3", "c2", "c1", "start"):
        k = known.select(F.col("context").alias(c), (F.col("n") - 1).alias(f"n_{c}"), (F.col("n_end") - 1).alias(f"e_{c}"))
        e = e.join(k, c, "left")
    share = lambda c: F.greatest(F.col(f"e_{c}"), F.lit(0)) / F.col(f"n_{c}")
    # a word that is known from ends only, and from none with the same word before it, is what cuts left of other words
    e = e.withColumn(
        "terminality",
        F.when(F.col("n_c3") >= 1, share("c3")).when(F.col("n_c2") >= LEAST_SEEN, share("c2")).when((F.col("n_c1") >= LEAST_SEEN) & (share("c1") < BARE), share("c1")),
    )
    # cut inside a word: longer words in the same place are far more frequent; the longer context is asked first
    split = F.split("context", "\x02")
    follow = counts.where(F.col("context").contains("\x02")).select(F.element_at(split, 1).alias("before"), F.element_at(split, 2).alias("next"), "n")
    ends3 = e.where("c1 not in ('#', '@') or last <> lower(last)").select("digest", "last", F.explode(F.array(F.struct(F.lit(3).alias("size"), F.element_at(F.split("c3", "\x02"), 1).alias("before")), F.struct(F.lit(2).alias("size"), F.element_at(F.split("c2", "\x02"), 1).alias("before")))).alias("z"))
    places = ends3.select("digest", "last", "z.size", "z.before").distinct()
    # asked once for each place and word, however many texts end so
    ask = places.select("before", "last").distinct()
    # a single capital is one of the names that stand there
    same = (F.col("next") == F.col("last")) | (F.col("next") == "@")
    spots = ask.join(follow, "before").where("startswith(next, lower(last)) or next = '@' and last <> lower(last)").groupBy("before", "last").agg(F.sum(F.when(~same, F.col("n"))).alias("longer"), F.max(F.when(same, F.col("n"))).alias("own"))
    one = lambda size: F.max(F.when(F.col("size") == size, F.struct(F.coalesce("longer", F.lit(0)).alias("longer"), F.coalesce("own", F.lit(1)).alias("own"))))
    by = places.join(spots, ["before", "last"]).groupBy("digest").agg(one(3).alias("x3"), one(2).alias("x2"))
    x = F.when((F.col("x3.longer") + F.col("x3.own") >= LONGER) | F.col("x2").isNull(), F.col("x3")).otherwise(F.col("x2"))
    inside = by.withColumn("x", x).where(F.col("x.longer") >= LONGER * F.col("x.own")).select("digest").withColumn("inside", F.lit(True))
    # sentences that begin like this one as a rule end without a stop: a heading, a list, a closing line. A sentence cut in its
    # first word has the beginning of other such cuts only, and so has one cut inside its second
    first, second = F.col("c3") == F.col("c2"), F.col("c3").startswith("^ ")
    bare = (F.col("n_start") >= LEAST_SEEN) & (share("start") >= BARE) & ~first & ~(second & F.coalesce("inside", F.lit(False)))
    e = e.join(inside, "digest", "left").select("digest", "terminality", (F.coalesce("inside", F.lit(False)) & ~F.coalesce(bare, F.lit(False))).alias("inside"), F.coalesce(bare, F.lit(False)).alias("bare"))

    verdict = ends.select("digest", "state").join(copies, "digest", "left").join(e, "digest", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("inside", "bare")})
    by_copy = F.coalesce("early", F.lit(False)) & (F.col("state") != "empty")
    by_mark = (F.col("state") == "marked") & ~F.col("bare") & (F.col("inside") | (F.coalesce("terminality", F.lit(0.0)) < MARKED))
    by_word = (F.col("state") == "open") & ~F.col("bare") & (F.col("inside") | (F.coalesce("terminality", F.lit(0.0)) < TERMINAL))
    evidence = F.when(by_copy, "copy").when(by_mark, "mark").when(by_word & F.col("inside"), "inside word").when(by_word, "closing word")
    verdict = verdict.select("digest", "state", evidence.alias("evidence"), F.round("terminality", 6).alias("terminality"), (by_copy | by_mark | by_word).alias("cut"))
    return ids.join(verdict, "digest").select("doc_id", "source", "state", "evidence", "terminality", "cut")


def by_source(verdicts: DataFrame) -> DataFrame:
    """(source, documents, cut, share): how often each source truncates."""
    per = verdicts.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("cut"), F.col("doc_id"))).alias("cut"))
    return per.select("source", "documents", "cut", F.round(F.col("cut") / F.col("documents"), 6).alias("share"))
