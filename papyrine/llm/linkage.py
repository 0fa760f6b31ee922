"""Matching entities across sources without keys: label-model linkage.

1. Profiles: one for every id, its words, author keys (surname and initial), abstract sentences,
   identifiers, numbers and date, all in normal form; texts are read once, in Arrow batches, and
   travel as hashes from there on.
2. Candidates: ids that share a blocking key. Keys are compound, so that common surnames, titles,
   issue-wide identifiers or sentences alone never make a block: two authors, two adjacent abstract
   sentences, an author of a small or very large team and two rare title words, an identifier and
   an author or a rare title word. In a block of at most BLOCK ids all meet. A larger block is
   divided by content: its ids meet where one's rarest title words, rarest sentences or identifiers
   stand in the other, which every pair needs whose titles, sentences or identifiers can agree
   (prefix filter). A pair that agrees in none of them is no match, whatever the size of its block
   (CONTENT), so none is lost to the size of a block.
   Ids with equal profiles are collapsed first and judged once, against their first one.
3. Heuristic matching functions vote match, differ or abstain on every candidate.
4. A generative model with the latent classes match, sibling and unrelated learns from the vote
   patterns alone how accurate each function is in each class and which ones are correlated (these
   get a joint table), and gives each pattern a posterior; 0 where no function of content agrees.
5. Pairs above the threshold are closed to works (connected components); all pairs of a work come
   out, each with a confidence.

Defined results: rows with a null id are ignored; any other field may be null, blank, a
placeholder or broken JSON and then makes its functions abstain; repeated rows change nothing;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from papyrine.llm.common import _letters, components
from papyrine.session import dropped, small, stored

#: Title words taken into keys: so many of the rarest.
RARE = 4
#: Teams up to which an author and two rare words make a key, and above which not all pairs of authors do.
SMALL_TEAM, LARGE_TEAM = 3, 12
#: In blocks of at most so many ids all meet; larger ones are divided by content.
BLOCK = 200
#: Shares of the smaller title and of the shorter list of sentences that must agree for a vote.
TITLE_AGREES, ABSTRACT_AGREES = 0.8, 0.4
#: Identifiers on so many ids or more are issue-wide and identify nothing.
ISSUE_WIDE = 8
#: Posterior from which a pair is a match; high, because a wrong link joins whole works.
THRESHOLD = 0.9
#: Vocabularies up to this many words (some 10 MB) are broadcast.
BROADCAST_WORDS = 300_000
#: Words that carry no content in titles (fixed values).
STOP = "a an and as at by for from in is of on or the to with preprint version".split()
#: Marks of works about or after another work, in titles (fixed patterns): kind, pattern.
RELATIONS = (
    ("correction", r"\b(?:correction|corrigendum|erratum|errata|addendum|retraction|retracted|expression of concern)\b"),
    ("comment", r"\b(?:comment(?:ary|s)? on|reply to|response to|in reply|in response|letter to)\b|^\s*re:"),
    ("part", r"\bpart\s+(?:\d+|[ivx]+)\b|(?:^|[.:;]\s*)[ivx]{1,4}\.\s"),
    ("sequel", r"\b(?:second|third|fourth|fifth|interim|final) report\b|\b\S+[- ]years? (?:update|follow[- ]?up|results)\b|\bfollow[- ]?up results\b|:\s*an? update\b"),
)


_RELATIONS = [(k, re.compile(p, re.A)) for k, p in RELATIONS]
_PART = re.compile(r"\bpart\s+(\d+|[ivx]+)\b", re.A)
_TAG, _AND, _ENTITY = re.compile(r"<[^<>]{0,200}>"), re.compile(r"&amp;|&#38;"), re.compile(r"&#?\w{1,10};", re.A)
_RUN, _NOT_RUN, _NUMBER = re.compile(r"[a-z0-9]+"), re.compile(r"[^a-z0-9]+"), re.compile(r"[0-9]+(?:\.[0-9]+)?")
_HEADS = re.compile(r"\b(?:background|introduction|objectives?|purpose|aims?|methods?|results|findings|conclusions?|discussion)\s*:\s*", re.A)
_SENTENCE = re.compile(r"(?<=[.!?])\s+", re.A)
_HYPHEN, _MIXED, _UPPER = re.compile(r"(?<=\w)[-\u2010-\u2013](?=\d)", re.A), re.compile(r"[a-z]+\d[a-z0-9]*", re.A), re.compile(r"\b([A-Z]{3,6})\b", re.A)
_INITIALS = re.compile(r"^(.*\S)\s+([A-Z])[A-Z]{0,2}$", re.A)
_OTHERS = re.compile(r"^(?:al\.?|others|)\|")
_LIST = re.compile(r"^\s*\[.*\]\s*$", re.S)
_FOLD = str.maketrans(*_letters())
_MOST_SEEN, _MOST_NAMES = 200_000, 50_000
#: Rows read at once, so that a worker's lists stay small.
_PIECE = 1000


def fold(text: str) -> str:
    """Lower case, accents removed, markup and entities blanked."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", _AND.sub(" and ", text))
    return (text if text.isascii() else text.translate(_FOLD)).lower()


def relation(title: str) -> str:
    """The relation marks of a title with their numbers, as one string; empty for none."""
    low = title.lower()
    found = [k for k, p in _RELATIONS if p.search(low)]
    if not found:
        return ""
    part = _PART.search(low)
    return "".join(f"{k}:{part.group(1) if part else ''}" for k in found)


def specifics(title: str) -> list[str]:
    """Names of genes, compounds, trials and the like in a title: words of letters and digits, or in capitals, or long coined ones.

    A title all in capitals has no names by case; hyphens inside a name are disregarded.
    """
    bare = _HYPHEN.sub("", _ENTITY.sub(" ", _TAG.sub(" ", title)))
    mixed = [w for w in _RUN.findall(bare.lower()) if _MIXED.fullmatch(w)]
    upper = [w.lower() for w in _UPPER.findall(bare)] if re.search("[a-z]", bare) else []
    return list(dict.fromkeys(mixed + upper))


def author_key(name: str) -> str:
    """Surname and first initial of a name as "Surname, Given", "Surname GS" or "Given G. Surname"."""
    n = " ".join(name.split())
    if "," in n:
        parts = n.split(",")
        return fold(f"{parts[0].strip()}|{parts[1].strip()[:1]}")
    behind = _INITIALS.match(n)
    return fold(f"{behind.group(1)}|{behind.group(2)}" if behind else f"{n.rsplit(' ', 1)[-1]}|{n[:1]}")


def _strings(text: str | None) -> list[str]:
    """The strings of a JSON array; an empty list for null, empty or incomplete JSON."""
    if not text or not _LIST.match(text):
        return []
    try:
        values = json.loads(text)
    except ValueError:
        return []
    return [v if isinstance(v, str) else json.dumps(v) for v in values if v is not None]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of a row in normal form, as hashes."""
    import xxhash

    seen: dict[str, int] = {}
    names: dict[str, int | None] = {}

    def author(n: str) -> int | None:
        if n not in names:
            if len(names) > _MOST_NAMES:
                names.clear()
            a = author_key(n)
            names[n] = None if _OTHERS.match(a) else code(a)
        return names[n]

    def code(x: str) -> int:
        h = seen.get(x)
        if h is None:
            if len(seen) > _MOST_SEEN:
                seen.clear()
            h = seen[x] = xxhash.xxh64_intdigest(x) - (1 << 63)
        return h

    def long(x: str) -> int:
        return xxhash.xxh64_intdigest(x) - (1 << 63)

    distinct = lambda of: list(dict.fromkeys(of))
    for b in (whole.iloc[at : at + _PIECE] for whole in batches for at in range(0, len(whole), _PIECE)):
        out: dict[str, list] = {c: [] for c in ("title", "relation", "specifics", "authors", "sentences", "numbers", "keywords")}
        for title, abstract, authors, keywords in zip(b["title"], b["abstract"], b["authors_json"], b["keywords_json"], strict=True):
            title = title or ""
            out["title"].append([code(w) for w in dict.fromkeys(_RUN.findall(fold(title))) if w not in STOP])
            out["relation"].append(relation(title))
            out["specifics"].append(specifics(title))
            bare = _HEADS.sub("", fold(abstract or ""))
            parts = [_NOT_RUN.sub(" ", s).strip() for s in _SENTENCE.split(bare)]
            out["sentences"].append([long(s) for s in parts if s.count(" ") >= 4])
            out["numbers"].append([code(x) for x in dict.fromkeys(_NUMBER.findall(bare))])
            out["authors"].append(distinct(a for a in (author(n) for n in _strings(authors) if n.strip()) if a is not None))
            out["keywords"].append(distinct(code(fold(k).strip()) for k in _strings(keywords)))
        yield b[["id", "doi", "own", "day"]].assign(**out)


def usable_doi(doi: Column) -> Column:
    """A doi without resolver or mark, in lower case; null unless it has prefix, slash and suffix."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(doi, r"(?U)^\s+|\s+$", ""), r"(?i)^(?:https?://[^/\s]+/|doi:?\s*)+", ""))
    return F.when(bare.rlike(r"^10\.\d{4,}/\S"), bare)


def profiles(papers: DataFrame) -> DataFrame:
    """One row for every id: (id, title, relation, specifics, authors, sentences, numbers, dois, own, day, keywords)."""
    own = F.when(F.lower("paper_id").rlike(r"^10\.\d{4,}/\S"), F.regexp_replace(F.lower("paper_id"), r"v\d+$", ""))
    doi = F.regexp_replace(usable_doi(F.col("doi")), r"(?<=\d)v\d+$", "")
    day = F.datediff(F.coalesce(F.expr("try_to_date(substring(published_date, 1, 10), 'yyyy-MM-dd')"), F.expr("try_to_date(concat(substring(published_date, 1, 7), '-15'), 'yyyy-MM-dd')")), F.lit("1970-01-01").cast("date"))
    flat = papers.where("paper_id is not null").select(F.col("paper_id").alias("id"), doi.alias("doi"), own.alias("own"), day.cast("double").alias("day"), "title", "abstract", "authors_json", "keywords_json")
    schema = "id string, doi string, own string, day double, title array<long>, relation string, specifics array<string>, authors array<long>, sentences array<long>, numbers array<long>, keywords array<long>"
    rows = flat.mapInPandas(_read, schema).withColumn("day", F.when(~F.isnan("day"), F.col("day").cast("int")))
    # of several rows the fullest field counts; constant-size aggregates, whatever share of the rows an id holds
    full = lambda c: F.max_by(c, F.size(c) * 1000 + F.pmod(F.xxhash64(c), F.lit(1000))).alias(c)
    one = rows.groupBy("id").agg(full("title"), full("specifics"), F.max("relation").alias("relation"), full("authors"), full("sentences"), full("numbers"), F.max("doi").alias("doi"), F.max("own").alias("own"), F.max("day").alias("day"), full("keywords"))
    return one.withColumn("dois", F.array_distinct(F.array_compact(F.array("doi", "own")))).drop("doi")


def _two(of: Column) -> Column:
    """Keys of all pairs of an array's values."""
    return F.flatten(F.transform(of, lambda x, i: F.transform(F.slice(of, i + 2, F.size(of)), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))


def blocking_keys(p: DataFrame) -> DataFrame:
    """(key, id): compound blocking keys of every profile, each of them once.

    One author and one word are no evidence among common names and topics, and their blocks grow with
    the square of the input; two authors, or one author of a small team and two words, are. A list of
    more than LARGE_TEAM authors gives pairs of its LARGE_TEAM smallest only, which would grow with the
    square of a team; instead each of its authors makes keys with two rare words, as do the authors of
    smaller teams where such a key exists.
    """
    adjacent = p.where("size(sentences) > 1").select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("sentences") - 1), lambda i: F.xxhash64(F.lit("s"), F.element_at("sentences", i), F.element_at("sentences", i + 1))))).alias("key"))
    teams = p.select("id", F.explode(_two(F.slice(F.array_sort("authors"), 1, LARGE_TEAM))).alias("t")).select("id", F.xxhash64(F.lit("t"), "t").alias("key"))
    worded = p.select("id", F.size("authors").alias("n"), F.explode("authors").alias("a"), _two(F.col("rare")).alias("ww")).select("id", "n", "a", F.explode("ww").alias("w")).select("id", "n", F.xxhash64(F.lit("a"), "a", "w").alias("key"))
    author_words = worded.where(F.col("n") <= SMALL_TEAM).select("id", "key")
    large = worded.where(F.col("n") > LARGE_TEAM).select("id", "key")
    between = worded.where((F.col("n") > SMALL_TEAM) & (F.col("n") <= LARGE_TEAM)).join(large.select("key").distinct(), "key", "left_semi").select("id", "key")
    between = stored(between, "between", release=True)
    with_ = F.concat(F.transform("authors", lambda a: F.xxhash64(F.lit("a"), a)), F.transform("rare", lambda w: F.xxhash64(F.lit("w"), w)))
    doi_with = p.select("id", F.explode("dois").alias("d"), with_.alias("with")).select("id", "d", F.explode("with").alias("w")).select("id", F.xxhash64(F.lit("d"), "d", "w").alias("key"))
    return adjacent.unionByName(teams).unionByName(author_words).unionByName(large).unionByName(between).unionByName(doi_with).select("key", "id")


def _prefix(size: Column, share: float) -> Column:
    """How many values of a set of this size can be looked up so that a set agreeing in `share` of it is met."""
    return size - F.ceil(size * F.lit(share - 1e-9)).cast("int") + 1


def _by_content(hot: DataFrame, p: DataFrame, block: int) -> DataFrame:
    """(a, b), a < b: ids of `hot` (id, keys) that share one of these keys and can agree in title, rare words, sentences or identifiers.

    An id asks with its rarest values for all ids that have them; who has a common value is dealt into
    parts, so no task grows with a value.
    """
    m = p.join(hot.select("id"), "id", "left_semi")
    s = m.select("id", F.explode("sentences").alias("v"))
    rarest = s.join(s.groupBy("v").agg(F.count("*").alias("n")), "v").groupBy("id").agg(F.transform(F.array_sort(F.collect_set(F.struct("n", "v"))), lambda x: x["v"]).alias("of"))

    def having(of: DataFrame, mark: str, asks: Column) -> DataFrame:
        return of.select("id", F.posexplode("of").alias("i", "v"), asks.alias("k")).select("id", F.xxhash64(F.lit(mark), "v").alias("v"), (F.col("i") < F.col("k")).alias("asks"))

    size = F.size("of")
    values = having(m.select("id", F.col("title").alias("of")), "w", F.greatest(F.lit(RARE), _prefix(size, TITLE_AGREES)))
    values = values.unionByName(having(rarest, "s", _prefix(size, ABSTRACT_AGREES))).unionByName(having(m.select("id", F.col("dois").alias("of")), "d", size))
    values = stored(values, "values")
    parts = values.groupBy("v").agg(F.count("*").alias("n"), F.max("asks").alias("any")).where("n > 1 and any").select("v", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    asking = values.where("asks").join(parts, "v").select("v", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = values.join(parts, "v").select("v", F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    pairs = asking.join(asked, ["v", "part"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda c: hot.select(F.col("id").alias(c), F.col("keys").alias(f"keys_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("keys_a", "keys_b")).select("a", "b")


def candidates(p: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: ids that share a block, large blocks divided by content.

    Keys go over the network once, to where they are counted; only the ids of blocks of two or more are written
    and shuffled again.
    """
    sized = blocking_keys(p).withColumn("n", F.count("*").over(W.Window.partitionBy("key"))).where("n > 1")
    sized = stored(sized, "keys", release=True)
    few = sized.where(F.col("n") <= block).select("key", "id")
    other = few.select("key", F.col("id").alias("b"))
    pairs = few.withColumnRenamed("id", "a").join(other, "key").where("a < b").select("a", "b")
    hot = stored(sized.where(F.col("n") > block).groupBy("id").agg(F.collect_set("key").alias("keys")), "large")  # an id's own keys
    if hot.limit(1).count():
        pairs = pairs.unionByName(_by_content(hot, p, block))
    return pairs.distinct()


def _overlap(x: str, y: str) -> Column:
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))


#: The matching functions, in the order of the pattern; see votes().
FUNCTIONS = ("identifier", "title", "relation", "specifics", "authors", "abstract", "rare", "numbers", "date", "keywords")
#: Functions of content: a pair is a match only if one of these votes so, which is what candidates() asks of the pairs of a large block.
CONTENT = ("identifier", "title", "abstract", "rare")
#: Functions whose vote "differ" is known to be hardly ever wrong, and how often it may be among matches. Siblings of one
#: team are as frequent as matches and agree in all else, so that without this bound they are learned as matches.
TRUSTED = {"relation": 1e-6, "specifics": 1e-3}


def votes(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """(a, b, one column of -1, 0, 1 for each function)."""
    side = lambda s: p.select(*[F.col(c).alias(f"{c}_{s}") for c in p.columns])
    j = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    vote = lambda yes, no: F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)
    journal = lambda s: F.array_except(f"own_dois_{s}", F.array(F.coalesce(f"own_{s}", F.lit(""))))
    title, authors, sentences, numbers = _overlap("title_a", "title_b"), _overlap("authors_a", "authors_b"), _overlap("sentences_a", "sentences_b"), _overlap("numbers_a", "numbers_b")
    shared = F.size(F.array_intersect("authors_a", "authors_b"))
    few = lambda c, n: F.least(F.size(f"{c}_a"), F.size(f"{c}_b")) >= n
    rare = F.size(F.array_intersect("rare_a", "title_b")) + F.size(F.array_intersect("rare_b", "title_a"))
    rare = rare / F.greatest(F.size("rare_a") + F.size("rare_b"), F.lit(1))
    days = F.abs(F.col("day_a") - F.col("day_b"))
    keywords = _overlap("keywords_a", "keywords_b")
    # names with a slip of the pen are no evidence: a name differs if none of the other title is within an edit or a swap of it
    same = lambda x, y: (x == y) | (F.levenshtein(x, y) <= 2) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))) | (F.levenshtein(x, y) <= 1) & (F.greatest(F.length(x), F.length(y)) >= 5)
    left = F.exists("specifics_a", lambda x: ~F.exists("specifics_b", lambda y: same(x, y)))
    right = F.exists("specifics_b", lambda x: ~F.exists("specifics_a", lambda y: same(x, y)))
    differ = few("specifics", 1) & left & right
    return j.select(
        "a",
        "b",
        vote(F.arrays_overlap("own_dois_a", "own_dois_b"), (F.size(journal("a")) > 0) & (F.size(journal("b")) > 0) & ~F.arrays_overlap(journal("a"), journal("b"))).alias("identifier"),
        vote(few("title", 2) & (title >= TITLE_AGREES), few("title", 2) & (title < 0.5)).alias("title"),
        vote(F.lit(False), F.col("relation_a") != F.col("relation_b")).alias("relation"),
        vote(F.arrays_overlap("specifics_a", "specifics_b") & ~differ, differ).alias("specifics"),
        vote(((authors >= 0.6) & (shared >= 2)) | ((authors == 1) & (shared == 1)), few("authors", 1) & (authors < 0.34)).alias("authors"),
        vote(few("sentences", 1) & (sentences >= ABSTRACT_AGREES), few("sentences", 3) & (sentences < 0.15)).alias("abstract"),
        vote(rare >= 0.6, few("title", 2) & (rare < 0.3)).alias("rare"),
        vote(few("numbers", 2) & (numbers >= 0.5), few("numbers", 3) & (numbers < 0.25)).alias("numbers"),
        vote(days <= 900, days > 1600).alias("date"),
        vote(few("keywords", 3) & (keywords >= 0.6), few("keywords", 3) & (keywords < 0.3)).alias("keywords"),
    )


class LabelModel:
    """Three latent classes: match, sibling (another work of the same team or topic) and unrelated.

    Every function, or clique of correlated functions, has a table of votes for each class. Fitted on
    pattern counts (at most 3 to the power of the functions rows) by expectation maximisation: the
    majority vote starts matches and unrelated pairs, vetoes of trusted functions start siblings.
    After a first fit as if the functions were independent, those whose joint votes depart most from
    that within the classes are joined to cliques, and the model is fitted again. Learned under the
    bounds of the trusted functions, the tables stay distributions.
    """

    CLASSES = 3

    def __init__(self, smooth: float = 1.0, most_cliques: int = 3, least_information: float = 0.01) -> None:
        self.smooth, self.most_cliques, self.least_information = smooth, most_cliques, least_information

    def fit(self, patterns: np.ndarray, counts: np.ndarray, trusted: dict[int, float] | None = None) -> "LabelModel":
        """patterns: rows of -1, 0, 1; counts: how many pairs have each; trusted: bound of a function's share of -1 among matches.

        Leaves `post`, the posterior of a match for each pattern.
        """
        x, n = patterns.astype(np.int64) + 1, counts.astype(np.float64)
        self.trusted = trusted or {}
        self.cliques: list[tuple[int, ...]] = [(i,) for i in range(x.shape[1])]
        score = 1 / (1 + np.exp(-2.0 * patterns.sum(1)))
        vetoed = (patterns[:, list(self.trusted)] < 0).any(1) if self.trusted else np.zeros(len(x), dtype=bool)
        start = np.stack([np.where(vetoed, 0.01, score), np.where(vetoed, score, 0.05), 1 - score + 0.01], 1)
        start = start / start.sum(1, keepdims=True)
        post = self._em(x, n, start)
        self.cliques = self._joined(x, n, post)
        self.post = self._em(x, n, post)[:, 0]
        return self

    @staticmethod
    def _codes(x: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
        code = np.zeros(len(x), dtype=np.int64)
        for i in clique:
            code = code * 3 + x[:, i]
        return code

    def _learn(self, x: np.ndarray, weight: np.ndarray) -> None:
        self.prior = (weight.sum(0) + self.smooth) / (weight.sum() + self.CLASSES * self.smooth)
        self.tables = []
        for clique in self.cliques:
            code, size = self._codes(x, clique), 3 ** len(clique)
            t = np.stack([np.bincount(code, weight[:, c], size) + self.smooth for c in range(self.CLASSES)])
            t /= t.sum(1, keepdims=True)
            if (most := self.trusted.get(clique[0])) is not None and t[0, 0] > most:
                t[0] *= (1 - most) / (1 - t[0, 0])
                t[0, 0] = most
            self.tables.append(t)

    def _posterior(self, x: np.ndarray) -> np.ndarray:
        logs = np.tile(np.log(self.prior), (len(x), 1))
        for clique, t in zip(self.cliques, self.tables, strict=True):
            logs += np.log(t[:, self._codes(x, clique)]).T
        logs -= logs.max(1, keepdims=True)
        post = np.exp(logs)
        return post / post.sum(1, keepdims=True)

    def _em(self, x: np.ndarray, n: np.ndarray, post: np.ndarray, rounds: int = 300) -> np.ndarray:
        for _ in range(rounds):
            self._learn(x, n[:, None] * post)
            new = self._posterior(x)
            done = np.abs(new - post).max(initial=0.0) < 1e-6
            post = new
            if done:
                break
        return post

    def _joined(self, x: np.ndarray, n: np.ndarray, post: np.ndarray) -> list[tuple[int, ...]]:
        """Cliques of two, by the mutual information of their votes given the latent class."""
        m = x.shape[1]
        free = [i for i in range(m) if i not in self.trusted]
        found = []
        for a, i in enumerate(free):
            for j in free[a + 1 :]:
                info = 0.0
                for c in range(self.CLASSES):
                    w = n * post[:, c]
                    joint = np.bincount(self._codes(x, (i, j)), w, 9).reshape(3, 3) + 1e-9
                    joint /= joint.sum()
                    apart = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                    info += w.sum() / max(n.sum(), 1e-9) * float((joint * np.log(joint / apart)).sum())
                found.append((info, i, j))
        used: set[int] = set()
        cliques: list[tuple[int, ...]] = []
        for info, i, j in sorted(found, reverse=True):
            if info >= self.least_information and len(cliques) < self.most_cliques and not used & {i, j}:
                cliques.append((i, j))
                used |= {i, j}
        return cliques + [(i,) for i in range(m) if i not in used]


def _enriched(p: DataFrame) -> DataFrame:
    """The profiles with title words by rarity, the rarest ones, and the identifiers that are not issue-wide."""
    n = stored(p.select(F.explode("title").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "counts")
    n = F.broadcast(n) if small(n, BROADCAST_WORDS) else n
    by_rarity = p.select("id", F.explode("title").alias("w")).join(n, "w").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda s: s["w"]).alias("title"))
    issue = p.select(F.explode("dois").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") < ISSUE_WIDE)
    own = p.select("id", F.explode("dois").alias("w")).join(issue, "w").groupBy("id").agg(F.collect_list("w").alias("own_dois"))
    p = p.drop("title").join(by_rarity, "id", "left").join(own, "id", "left")
    p = p.withColumn("title", F.coalesce("title", F.array().cast("array<long>"))).withColumn("own_dois", F.coalesce("own_dois", F.array().cast("array<string>")))
    return p.withColumn("rare", F.slice("title", 1, RARE))


def scored_pairs(papers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, confidence, the votes) of all candidates, and of every collapsed id with its representative."""
    p = profiles(papers)
    # equal profiles with enough content are one record under several ids
    digest = F.when((F.size("sentences") > 1) & (F.size("authors") > 0), F.xxhash64("title", "relation", "specifics", F.array_sort("authors"), "sentences", "dois", "day"))
    first = stored(p.withColumn("digest", F.coalesce(digest, F.xxhash64(F.lit("own"), "id"))), "profiles", release=True)
    p = first
    rep = p.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep")
    same = stored(p.select("id", "digest").join(rep, "digest").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "same")
    p = stored(_enriched(p.drop("digest").join(same.select(F.col("b").alias("id")), "id", "left_anti")), "profiles", release=True)
    dropped(first)

    met = stored(candidates(p, block), "candidates", release=True)
    ballots = stored(votes(met, p), "votes", release=True)
    table = ballots.groupBy(*FUNCTIONS).agg(F.count("*").alias("n")).toPandas()  # at most 3 ** len(FUNCTIONS) rows
    table["confidence"] = 0.0
    if len(table):
        model = LabelModel().fit(table[list(FUNCTIONS)].to_numpy(), table["n"].to_numpy(), {FUNCTIONS.index(f): e for f, e in TRUSTED.items()})
        table["confidence"] = np.where((table[list(CONTENT)] > 0).any(axis=1), model.post, 0.0)
    known = p.sparkSession.createDataFrame(table[[*FUNCTIONS, "confidence"]].astype({f: "int32" for f in FUNCTIONS} | {"confidence": "float64"}), ", ".join(f"{f} int" for f in FUNCTIONS) + ", confidence double")
    judged = ballots.join(F.broadcast(known), list(FUNCTIONS))
    alike = same.select(*[F.lit(0).alias(f) for f in FUNCTIONS], "a", "b", F.lit(1.0).alias("confidence"))
    return judged.unionByName(alike.select(judged.columns))


def works(judged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, work): the ids of works with two or more, `work` the smallest."""
    return components(judged.where(F.col("confidence") >= threshold).select("a", "b")).withColumnRenamed("root", "work")


def linked(papers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(paper_id_a, paper_id_b, confidence, direct): all pairs of every work.

    A pair that was a candidate itself has its posterior; one that only follows from others has the
    least confidence of its work's links, and direct is false.
    """
    judged = stored(scored_pairs(papers), "judged")
    groups = stored(works(judged, threshold), "works")
    least = judged.where(F.col("confidence") >= threshold).select(F.col("a").alias("id"), "confidence").join(groups, "id").groupBy("work").agg(F.min("confidence").alias("least"))
    pairs = groups.select("work", F.col("id").alias("a")).join(groups.select("work", F.col("id").alias("b")), "work").where("a < b")
    direct = judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence")
    return pairs.join(least, "work").join(direct, ["a", "b"], "left").select(F.col("a").alias("paper_id_a"), F.col("b").alias("paper_id_b"), F.round(F.coalesce("confidence", "least"), 6).alias("confidence"), F.col("confidence").isNotNull().alias("direct"))
