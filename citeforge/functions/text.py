"""Column functions for text: normalising, splitting, hashing, tokens, excerpts and predicates.

All are built from Spark's own functions, so they stay in generated code and push down as usual.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's ``\\s`` and ``strip`` see it; Java's own ``\\s`` is ASCII.
WS = r"[\s\x0b\x1c-\x1f\x85   -     　]"
LINEBREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# Word lists that results depend on.
RETRIEVAL_STOPWORDS = ["a", "an", "and", "as", "by", "does", "is", "it", "of", "or", "the", "to", "what", "which", "with"]
SEMANTIC_STOPWORDS = ["a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "with"]
NEGATIONS = ["no", "not", "never", "none", "without"]

# Values that count as not set. The third credential pattern is this engine's own: any
# assignment to a name that ends in _API_KEY.
UNSET = ["", "unset", "not_recorded", "not_applicable_for_ready_check"]
CREDENTIALS = [r"sk-[A-Za-z0-9_\-]{12,}", r"(?i)Bearer\s+[A-Za-z0-9_\-.]{12,}", r"(?i)[A-Z]+_API_KEY\s*="]


def truthy(c: Column) -> Column:
    """Null where a string is empty, so that ``coalesce`` falls through as ``or`` does."""
    return F.nullif(c, F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first string that is neither null nor empty, else the empty string."""
    return F.coalesce(*[truthy(c) for c in columns], F.lit(""))


#: The characters of ``WS``, for trimming, which unlike a pattern at the end takes linear time.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def sentences(c: Column) -> Column:
    """Sentences of the normalised text; empty ones are dropped."""
    return F.filter(F.split(normalize(c), r"(?<=[.!?]) "), lambda s: s != "")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    return F.substring(sha256(c), 1, 16)


def span_hash(c: Column) -> Column:
    """Hash of a span: text and each of its lines without blanks at the end; line ends become one."""
    lines = F.transform(F.split(strip(c), LINEBREAK, -1), lambda s: F.rtrim(s, F.lit(BLANKS)))
    return sha256(F.array_join(lines, "\n"))


def id_part(c: Column) -> Column:
    """Lower case, all else than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")


def slug(c: Column) -> Column:
    return F.coalesce(truthy(id_part(c)), F.lit("untitled"))


def snapshot_id(dataset: Column, split: Column, version: Column, digest: Column) -> Column:
    return F.concat_ws("_", id_part(dataset), id_part(split), id_part(version), F.substring(digest, 1, 16))


def tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Runs of ASCII letters and digits of the lower-case text, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(stopwords)) if stopwords else found


def excerpt(c: Column, limit: int = 240) -> Column:
    """The normalised text, cut with an ellipsis where it is longer than ``limit``."""
    text = normalize(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def citation_id(c: Column) -> Column:
    """A cited id without blanks, then without quotes and backquotes, at its ends."""
    return F.regexp_replace(strip(c), r"\A[`'\"]+|[`'\"]+\z", "")


def has_credential(c: Column) -> Column:
    hit = F.lit(False)
    for p in CREDENTIALS:
        hit = hit | c.rlike(p)
    return hit


def has_marker(c: Column) -> Column:
    """Marks of an unfinished prompt."""
    return F.lower(c).rlike("tbd|todo|turn[0-9]+")


def confirmation_url(html: Column, base: Column) -> Column:
    """The link that confirms a download on a warning page: one that has it, else the form's inputs
    as a query on ``base``; null where neither has a confirm value."""
    link = unescape(F.nullif(F.regexp_extract(html, r'href="([^"]*[?&](?:amp;)?confirm=[^"]*)"', 1), F.lit("")))
    inputs = F.transform(F.regexp_extract_all(html, F.lit(r"(<input\b[^>]*>)"), F.lit(1)), html_attributes)
    named = F.filter(inputs, lambda m: m["name"].isNotNull())
    pairs = F.transform(named, lambda m: F.concat(F.url_encode(m["name"]), F.lit("="), F.url_encode(F.coalesce(m["value"], F.lit("")))))
    form = F.when(F.exists(named, lambda m: m["name"] == "confirm"), F.concat(base, F.lit("?"), F.array_join(pairs, "&")))
    return F.coalesce(link, form)


def is_unset(c: Column, strict: bool = False) -> Column:
    """Null, or one of the words for it; with ``strict`` only the exact empty string and ``unset``."""
    return c.isNull() | (c.isin("", "unset") if strict else F.lower(F.trim(c)).isin(UNSET))


def is_empty(c: Column) -> Column:
    """A list or map that is null or has no entry counts as not set."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def is_positive(c: Column) -> Column:
    return F.coalesce(c.try_cast("double") > 0, F.lit(False))


def is_safe_component(c: Column) -> Column:
    """A path component without separators, drive letters or reserved characters."""
    return c.isNotNull() & ~c.isin("", ".", "..") & ~c.rlike(r'[/\\<>:"|?*]')


def rate(n: Column, d: Column) -> Column:
    """n / d to six places; 0 where d is 0."""
    return F.coalesce(F.bround(F.try_divide(n.cast("double"), d.cast("double")), 6), F.lit(0.0))


def confidence(c: Column) -> Column:
    """A number between 0 and 1; what is no number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets; 1 where both are empty, 0 where one is or they share nothing."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y)).cast("double")
    score = 2 * both / (F.size(x) + F.size(y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0) | (both == 0), 0.0).otherwise(score)


def html_attributes(tag: Column) -> Column:
    """``name="value"`` pairs of a tag as a map; the last of equal names wins."""
    pair = r'([A-Za-z_:][-A-Za-z0-9_:.]*)="([^"]*)"'
    names, values = (F.regexp_extract_all(tag, F.lit(pair), F.lit(k)) for k in (1, 2))
    last = F.filter(F.arrays_zip(names.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))).alias("i")), lambda e: e["k"].isNotNull() & (F.array_position(F.slice(names, e["i"] + 1, F.greatest(F.size(names) - e["i"], F.lit(0))), e["k"]) == 0))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], unescape(e["v"]))))


def unescape(c: Column) -> Column:
    """The five basic HTML entities."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def cost_usd(prompt: Column, completion: Column, per_million: tuple[float, float] = (0.435, 0.87)) -> Column:
    """Price of a call from its tokens, to six places."""
    return F.bround(prompt / 1e6 * per_million[0] + completion / 1e6 * per_million[1], 6)
