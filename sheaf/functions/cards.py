"""Column expressions for captured cards and their addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import strip

# Substrings that mark a card as page furniture.
NOISE_PATTERNS = ("privacy", "terms", "business services", "cookie", "linkedin corporation")

MIDDLE_DOT = "·"
VERIFIED_MARK = "(Verified job)"
DATE_PREFIX = "Posted on"


def card_texts(texts: Column) -> Column:
    """Trimmed texts without empty ones and lone middle dots."""
    return F.filter(F.transform(texts, strip), lambda t: (t != "") & (t != MIDDLE_DOT))


def date_text(spans: Column) -> Column:
    """First span that opens with the date prefix, else ''."""
    hits = F.filter(F.transform(spans, strip), lambda s: s.startswith(DATE_PREFIX))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def clean_designation(raw: Column) -> Column:
    """First line that is neither blank nor the verified mark."""
    lines = F.filter(F.split(raw, "\n"), lambda x: ~x.contains(VERIFIED_MARK))
    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.get(kept, F.lit(0))


def is_noise(designation: Column, company: Column) -> Column:
    """True for page furniture; a substring match, so it is broad on purpose."""
    joined = F.lower(F.concat(F.coalesce(designation, F.lit("")), F.lit(" "), F.coalesce(company, F.lit(""))))
    hit = designation.isNull() & company.isNull()
    for pattern in NOISE_PATTERNS:
        hit = hit | joined.contains(pattern)
    return hit


def posted_date(raw: Column, now: Column) -> Column:
    """Timestamp of a 'Posted on ...' text in either of two layouts, else ``now``."""
    bare = strip(F.get(F.split(strip(F.replace(raw, F.lit(DATE_PREFIX), F.lit(""))), "\n"), F.lit(0)))
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("MMMM d, yyyy, h:mm a")),
        F.try_to_timestamp(bare, F.lit("MMMM d, yyyy")),
        now,
    )


def query_value(url: Column, name: str) -> Column:
    """First non-empty value of a query parameter, decoded; null when absent."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    raw = F.regexp_extract(F.concat(F.lit("&"), query), rf"&{name}=([^&]+)", 1)
    return F.nullif(F.try_url_decode(raw), F.lit(""))


def canonical_url(url: Column, id_param: str = "currentJobId", base: str = "https://www.linkedin.com/jobs/view/") -> Column:
    """Address of the job itself when the page address names a job id."""
    job = query_value(url, id_param)
    return F.when(job.isNotNull(), F.concat(F.lit(base), job, F.lit("/"))).otherwise(url)


def domain_key(url: Column) -> Column:
    """Lower-case host without one leading 'www.'; '' when there is none."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def id_numbers(html: Column) -> Column:
    """Distinct numbers of 8 to 12 digits, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"\b(\d{8,12})\b"), F.lit(1)))


def job_id(url: Column, id_param: str = "currentJobId") -> Column:
    found = F.regexp_extract(url, rf"{id_param}=(\d+)", 1)
    return F.when(found != "", found).otherwise(F.lit("none"))


def search_query(*groups: Sequence[str]) -> str:
    """Boolean search text: each group joined by OR, the groups by AND."""
    return " AND ".join("(" + " OR ".join(g) + ")" for g in groups)


def search_query_column(*groups: Column) -> Column:
    parts = [F.concat(F.lit("("), F.concat_ws(" OR ", g), F.lit(")")) for g in groups]
    return F.concat_ws(" AND ", *parts)


def matches_search(text: Column, *groups: Sequence[str]) -> Column:
    """True when the text holds at least one keyword of every group."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(True)
    for group in groups:
        any_term = F.lit(False)
        for term in group:
            any_term = any_term | low.contains(term.lower())
        hit = hit & any_term
    return hit
