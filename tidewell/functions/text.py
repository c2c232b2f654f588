"""Scalar text kernels as Columns: tokens, overlaps, normal forms, hashes, estimates of length.

Every kernel is null-safe: a null text counts as empty. Token kernels work on code points; regexes
are ASCII on purpose, so that SQL engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query words and the words that widen them.
SYNONYMS = {
    "bug": ["issue", "error", "failure", "problem"],
    "issue": ["bug", "error", "problem"],
    "fix": ["patched", "resolved", "solution", "repair"],
    "python": ["py"],
    "asyncio": ["async", "await", "gather"],
    "llm": ["model", "assistant"],
    "preference": ["prefer", "favorite", "like"],
}
#: Entities that say nothing.
STOP_ENTITIES = ["example", "etc", "also", "however", "therefore", "using", "used", "use", "may", "can", "will"]
#: Phrases that make a text look like a fact.
FACT_PHRASES = ["i use ", "i prefer ", "we decided", "the plan is", "remember that"]
#: Substrings that place a preference.
LANGUAGES = ["python", "haskell", "java", "javascript", "rust", "go"]
TOOLS = ["vim", "emacs", "vscode", "cursor", "zed"]


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text(c)) / 4).cast("int")


def raw_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits, '_', '.', '/' and '-', with repeats."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9_./-]+"), F.lit(0))


def long_tokens(c: Column) -> Column:
    """raw_tokens of more than two characters."""
    return F.filter(raw_tokens(c), lambda t: F.length(t) > 2)


def long_set(c: Column) -> Column:
    """long_tokens, each once."""
    return F.array_distinct(long_tokens(c))


def split_tokens(c: Column) -> Column:
    """The set of raw tokens and of their pieces between '.', '_', '/' and '-', each of more than two characters."""
    t = raw_tokens(c)
    pieces = F.flatten(F.transform(t, lambda x: F.split(x, "[._/-]+")))
    return F.array_distinct(F.filter(F.concat(t, pieces), lambda x: F.length(x) > 2))


def overlap(query: Column, terms: Column) -> Column:
    """The share of the query's terms that occur in a set of terms; 0 if either is empty."""
    return F.when((F.size(query) > 0) & (F.size(terms) > 0), F.size(F.array_intersect(query, terms)) / F.greatest(F.lit(1), F.size(query))).otherwise(F.lit(0.0))


def density(query: Column, c: Column) -> Column:
    """The share of a text's raw tokens, with repeats, that are terms of the query."""
    t = raw_tokens(c)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.array_contains(query, x))) / F.size(t)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def coverage_score(query: Column, terms: Column) -> Column:
    """.7 of the query covered and .3 of the text's distinct terms hit, at most 1; 0 without a hit."""
    q, t = F.array_distinct(query), F.array_distinct(terms)
    hit = F.size(F.array_intersect(q, t))
    return F.when(hit > 0, F.least(F.lit(1.0), 0.7 * hit / F.greatest(F.lit(1), F.size(q)) + 0.3 * hit / F.greatest(F.lit(1), F.size(t)))).otherwise(F.lit(0.0))


def normal(c: Column) -> Column:
    """Trimmed, lower case, runs of white space made one blank."""
    return F.regexp_replace(F.lower(F.regexp_replace(text(c), r"^\s+|\s+$", "")), r"\s+", " ")


def entity(c: Column) -> Column:
    """normal, without punctuation at the ends."""
    return F.regexp_replace(normal(c), r"""^[.,;:!?"'()-]+|[.,;:!?"'()-]+$""", "")


def is_entity(c: Column) -> Column:
    """2 to 80 characters, no stop entity, not all digits."""
    return F.length(c).between(2, 80) & ~c.isin(*STOP_ENTITIES) & ~F.regexp_replace(c, "[.,]", "").rlike("^[0-9]+$")


def digest(c: Column, n: int = 64) -> Column:
    """The first n characters of the SHA-256 of a text."""
    return F.substring(F.sha2(text(c), 256), 1, n)


def pair_digest(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(text(a), F.lit("\x00"), text(b)), 256)


def expanded(terms: Column) -> Column:
    """A set of terms with the synonyms of its members."""
    none = F.array().cast("array<string>")
    more = [F.when(F.array_contains(terms, word), F.array(*map(F.lit, also))).otherwise(none) for word, also in SYNONYMS.items()]
    return F.array_distinct(F.concat(terms, *more))


def expanded_query(c: Column) -> Column:
    """The text and, sorted, the synonyms it lacks."""
    more = F.array_join(F.array_sort(F.array_except(expanded(split_tokens(c)), split_tokens(c))), " ")
    return F.when(more == "", text(c)).otherwise(F.concat(text(c), F.lit(" "), more))


def match_terms(c: Column, least: int = 1) -> Column:
    """The bag of words of a full-text query, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= least))


def within_tokens(c: Column, most: Column | int) -> Column:
    """The longest prefix of at most `most` estimated tokens."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(most <= 0, F.lit("")).otherwise(F.substring(text(c), F.lit(1), most * 4 + 3))


def summary(c: Column, words: int = 36) -> Column:
    """The first words, with ' ...' if any are left out."""
    w = F.filter(F.split(text(c), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) <= words, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit(" ...")))


def category(c: Column) -> Column:
    """language, tooling or general, by substring."""
    low = F.lower(text(c))
    return F.when(low.rlike("|".join(LANGUAGES)), "language").when(low.rlike("|".join(TOOLS)), "tooling").otherwise("general")


def looks_like_fact(c: Column) -> Column:
    return F.lower(text(c)).rlike("|".join(FACT_PHRASES))


def words(c: Column) -> Column:
    """The number of words between white space."""
    return F.size(F.filter(F.split(text(c), r"\s+"), lambda x: x != ""))


def sentences(c: Column, shortest: int = 10, longest: int = 1000) -> Column:
    """Sentences: cut at white space after a stop before a capital, and at blank lines."""
    s = F.transform(F.split(text(c), r"(?<=[.!?])\s+(?=[A-Z])|\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.transform(F.filter(s, lambda x: F.length(x) >= shortest), lambda x: F.substring(x, 1, longest))


def first_nonempty(*cs: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cs])
