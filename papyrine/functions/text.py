"""Column expressions for the fields of a paper: normal forms, hashes, tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token pattern of the ranker, on accent-free lower-cased text with other letters made "_" (a fixed value).
RANK_TOKEN = r"(\b[a-z][a-z0-9\-]+\b)"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key_of(c: Column) -> Column:
    """Cache key of a query or source: stripped, lower case."""
    return F.lower(strip(c))


def clean_abstract(c: Column) -> Column:
    """Null to empty, a leading "abstract" (any case) and one colon dropped, stripped."""
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^abstract\s*:?\s*", ""))


def http_url(c: Column) -> Column:
    """The address if it has a web scheme, else null."""
    return F.when(c.startswith("http://") | c.startswith("https://"), c)


def default_url(url: Column, source: Column, paper_id: Column, doi: Column) -> Column:
    """The given address, or the one a PubMed id or a preprint's doi leads to."""
    made = F.when(source == "pubmed", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), paper_id, F.lit("/"))).when((source == "biorxiv") & doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi))
    return F.coalesce(http_url(url), made)


def plain_doi(c: Column) -> Column:
    """Stripped, lower case, each resolver prefix dropped once in order; null for nothing left."""
    out = F.lower(strip(c))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        out = F.when(out.startswith(prefix), F.substr(out, F.lit(len(prefix) + 1))).otherwise(out)
    out = strip(out)
    return F.when(out != "", out)


def content_hash(title: Column, abstract: Column) -> Column:
    """First 16 hex digits of the SHA-256 of title and abstract, without a separator."""
    return F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))), 256), 1, 16)


def combined_text(title: Column, abstract: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit(""))))


def author_string(authors: Column) -> Column:
    """At most three names, "et al." for more, "Unknown authors" for none."""
    n = F.coalesce(F.size(authors), F.lit(0))
    named = F.concat_ws(", ", F.slice(authors, 1, 3))
    return F.when(n <= 0, "Unknown authors").when(n <= 3, named).otherwise(F.concat(named, F.lit(" et al.")))


def split_authors(c: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def string_list(c: Column) -> Column:
    """A JSON array of strings; null for anything else."""
    return F.when(c.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(c, "array<string>"))


def token_set(c: Column) -> Column:
    """Distinct runs of [a-z0-9] of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def _accented() -> tuple[str, str]:
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def rank_tokens(c: Column) -> Column:
    """Tokens of the ranker in order: lower case, accents stripped; other letters break no word boundary."""
    bare = F.translate(F.lower(F.coalesce(c, F.lit(""))), *_accented())
    return F.regexp_extract_all(F.regexp_replace(bare, r"[^\x00-\x7F]", "_"), F.lit(RANK_TOKEN), F.lit(1))


def first_words(c: Column, most: int = 400) -> Column:
    """The text unchanged if it has at most `most` words, else its first words joined by blanks."""
    w = F.split(strip(c), r"(?U)\s+")
    return F.when(F.size(w) <= most, c).otherwise(F.concat_ws(" ", F.slice(w, 1, most)))


def embedding_text(title: Column, abstract: Column, most: int = 400) -> Column:
    """Title twice, then the abstract; the title alone without one."""
    t, a = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(abstract, F.lit("")))
    return first_words(F.when(a == "", t).otherwise(F.concat(t, F.lit(". "), t, F.lit(". "), a)), most)


def canonical_entity(c: Column) -> Column:
    return F.lower(strip(c))


def query_number(c: Column) -> Column:
    """The number in an id like Q12, for sorting."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), F.lit(1)).cast("int")


def preview(c: Column, most: int = 400) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, most)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def coerced_id(df_columns: list[str]) -> Column:
    """The first id a foreign record has (paper_id, pmid, id), else its title in lower case with underscores."""
    known = [F.col(c).cast("string") for c in ("paper_id", "pmid", "id") if c in df_columns]
    made = F.regexp_replace(F.lower("title"), " ", "_") if "title" in df_columns else F.lit(None).cast("string")
    return F.coalesce(*known, made)
