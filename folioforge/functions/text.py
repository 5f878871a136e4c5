"""Column builders for text: tokens, overlaps, lexical scores, hashes, vectors, URLs.

All are built-in expressions, so they stay in generated code and prune and push down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([A-Za-z0-9Ѐ-ӿ]+)"
STOPWORDS = ("a", "an", "and", "are", "for", "in", "is", "of", "on", "or", "the", "to", "what", "who", "и", "в", "на", "по", "с", "что", "как")


def py_strip(c: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return py_strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1)))


def without_stopwords(t: Column) -> Column:
    return F.array_except(t, F.array(*map(F.lit, STOPWORDS)))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens (stopwords aside) that the text has; 0 without any."""
    q = without_stopwords(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def lexical_score(query: Column, text: Column) -> Column:
    """0.55 of token overlap + 0.25 for the whole query within the text + 0.20 of stem
    matches (tokens of 4 and more that contain one another or share 4 characters), at most 1."""
    return lexical_score_tokens(query, tokens(query), text, tokens(text))


def lexical_score_tokens(query: Column, q: Column, text: Column, t: Column) -> Column:
    """The same with the token sets at hand."""
    n = F.size(q)
    shared = F.size(F.array_intersect(q, t)) / n
    exact = F.when(F.contains(F.lower(text), py_strip(F.lower(query))), 1.0).otherwise(0.0)
    long = F.filter(t, lambda y: F.length(y) >= 4)
    stem = F.size(F.filter(q, lambda x: (F.length(x) >= 4) & F.exists(long, lambda y: F.contains(y, x) | F.contains(x, y) | (F.substring(x, 1, 4) == F.substring(y, 1, 4))))) / n
    return F.when(n > 0, F.least(F.lit(1.0), 0.55 * shared + 0.25 * exact + 0.20 * stem)).otherwise(F.lit(0.0))


def content_hash(c: Column) -> Column:
    return F.sha1(F.lower(squash(F.coalesce(c, F.lit("")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different lengths or of no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def relevance(cos: Column) -> Column:
    """Cosine distance d as 1 - d / 2, that is (1 + cos) / 2, in [0, 1]."""
    return clamp((F.lit(1.0) + cos) / 2)


def token_estimate(c: Column) -> Column:
    """Three quarters of the words, at least 1."""
    words = F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\S+)"), F.lit(1)))
    return F.greatest(F.lit(1), (words * 0.75).cast("int"))


def summary_budget(chars: Column, ratio: float, least: int, most: int) -> Column:
    """min(most, max(1, chars * ratio)), at least ``least`` where the text is longer than
    that, shorter than the text, and 1 at least."""
    b = F.least(F.lit(most), F.greatest(F.lit(1), (chars * ratio).cast("int")))
    b = F.when(chars > least, F.greatest(b, F.lit(least))).otherwise(b)
    b = F.when(chars > 1, F.least(b, chars - 1)).otherwise(b)
    return F.greatest(F.lit(1), b)


def script_of(c: Column) -> Column:
    """``russian`` where Cyrillic letters outnumber Latin ones and are 30 % of all
    characters that aren't space, ``english`` where Latin ones are 30 %, else null."""
    total = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    cyrillic = F.length(F.regexp_replace(c, "[^\\u0400-\\u04FF]", ""))
    return F.when((total > 0) & (cyrillic > latin) & (cyrillic >= 0.3 * total), "russian").when((total > 0) & (latin >= 0.3 * total), "english")


# --- URLs ------------------------------------------------------------------------------


def normalize_url(c: Column) -> Column:
    """Trimmed, without the fragment."""
    return F.trim(F.regexp_replace(F.trim(c), "#.*$", ""))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(url_path(c), r"(\.[^./]+)$", 1))


def is_http_url(c: Column) -> Column:
    return F.lower(c).rlike("^https?://[^/?#]")


def registrable_domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def in_scope(url: Column, start: Column, scope: str = "same_host", domains: tuple[str, ...] = ()) -> Column:
    """Scope of a crawl: ``same_host``, ``same_domain``, ``allowed_domains`` or ``allow_all``."""
    host = url_host(url)
    http = is_http_url(url)
    if scope == "allow_all":
        return http
    if scope == "same_host":
        return http & (host == url_host(start))
    if scope == "same_domain":
        return http & (registrable_domain(host) == registrable_domain(url_host(start)))
    if scope == "allowed_domains":
        hit = F.lit(False)
        for d in domains:
            hit = hit | (host == d.lower()) | F.endswith(host, F.lit("." + d.lower()))
        return http & hit
    raise ValueError(f"unknown scope {scope!r}")


KINDS = {".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".pptx": "pptx", ".xlsx": "excel", ".xls": "excel", ".csv": "csv", ".json": "json", ".txt": "text", ".md": "text", ".html": "html", ".htm": "html", ".png": "image", ".jpg": "image", ".jpeg": "image"}
CONTENT_TYPES = {"application/pdf": "pdf", "application/msword": "doc", "text/csv": "csv", "application/json": "json", "text/plain": "text", "text/html": "html", "application/xhtml+xml": "html", "image/png": "image", "image/jpeg": "image", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def content_type(c: Column) -> Column:
    return F.lower(F.trim(F.substring_index(c, ";", 1)))


def disposition_filename(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)filename\*?=(?:UTF-8'')?\"?([^\";]+)\"?", 1), F.lit(""))


def download_kind(url: Column, ctype: Column, disposition: Column) -> Column:
    """By the URL's extension, else the content type, else the file name offered."""
    name = F.lower(F.regexp_extract(disposition_filename(disposition), r"(\.[^./]+)$", 1))
    return F.coalesce(_lookup(url_extension(url), KINDS), _lookup(content_type(ctype), CONTENT_TYPES), _lookup(name, KINDS))


def needs_login(url: Column, status: Column, prefix: str | None = None) -> Column:
    """401 or 403, a URL under the login page, or a path segment that says so."""
    hit = status.isin(401, 403) | F.lower(url_path(url)).rlike("/(login|signin|sign-in|auth)(/|$)")
    return hit | F.startswith(url, F.lit(prefix)) if prefix else hit


def header(headers: Column, name: str) -> Column:
    """A header's value in a map of them, whatever its case; null if it isn't there."""
    lower = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.element_at(F.map_filter(lower, lambda k, _: k == name.lower()), name.lower())


def is_html_response(ctype: Column, url: Column) -> Column:
    """By the content type; without one, unless the URL's extension is that of another kind."""
    kind = F.coalesce(content_type(ctype), F.lit(""))
    other = F.coalesce(_lookup(url_extension(url), KINDS), F.lit("html")) != "html"
    return F.when(kind != "", kind.isin("text/html", "application/xhtml+xml")).otherwise(~other)
