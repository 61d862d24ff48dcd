"""Scores and predicates over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidenta.functions import text as X

#: Limits of identity and content checks.
TITLE, TITLE_WITH_DOI, TITLE_WITH_NAMES, NAMES = 0.60, 0.30, 0.40, 0.5
PDF_BYTES, PDF_CHARS, PDF_PAGES, BODY_WORDS, JATS_SECTIONS, CHARS_A_WORD, LONG_PAGES = 20_000, 2_000, 2, 1_500, 2, 6, 3
#: Weights of a passage's rank, density of numbers and table signal.
W_RANK, W_ANCHOR, W_TABLE, DENSITY = 1.0, 0.6, 0.5, 40.0
#: Sizes of a model's context.
WORDS_TO_TOKENS, STEP, LEAST_CONTEXT, MOST_CONTEXT = 1.4, 512, 2048, 8192


def identity(title: Column, doi_hit: Column, names: Column) -> Column:
    """Whether a document is the paper's, by title, DOI and share of author names."""
    return (title >= TITLE) | (doi_hit & (title >= TITLE_WITH_DOI)) | ((names >= NAMES) & (title >= TITLE_WITH_NAMES))


def body_words(latex: Column) -> Column:
    """Words of a LaTeX body without commands and marks (F32)."""
    body = F.element_at(F.split(X.text_of(latex), r"\\begin\s*\{document\}", 2), -1)
    return F.size(X.words(F.regexp_replace(body, r"\\[a-zA-Z@]+\*?|[{}$&~%^_#]|\\\\|\\[\[\]]", " ")))


def content(kind: Column, body: Column, n_bytes: Column, n_pages: Column, filled_pages: Column, n_sections: Column) -> Column:
    """(passed, reason): whether a fetched body is a whole article, by its representation (P10)."""
    t = X.text_of(body)
    head = F.lower(F.ltrim(F.substring(t, 1, 400)))
    page = head.startswith("<!doctype html") | head.startswith("<html") | head.contains("<title>error")
    n_words = F.size(X.words(t))
    n_latex = body_words(t)
    has_body = t.rlike(r"\\begin\s*\{document\}")
    chars = F.length(t)
    reason = (
        F.when(n_bytes == 0, "empty_response")
        .when((kind == "latex") & ~has_body, "no_begin_document")
        .when((kind == "latex") & (n_latex < BODY_WORDS), "thin_latex")
        .when((kind != "latex") & page, "html_or_error_page")
        .when((kind == "jats") & ((n_sections < JATS_SECTIONS) | (n_words < BODY_WORDS)), "thin_jats")
        .when((kind == "pdf") & (n_bytes < PDF_BYTES), "pdf_too_small")
        .when((kind == "pdf") & ((chars < PDF_CHARS) | (filled_pages < PDF_PAGES)), "thin_text")
        .when((kind == "pdf") & (chars / CHARS_A_WORD < BODY_WORDS) & (n_pages < LONG_PAGES), "abstract_sized")
    )
    return F.struct(reason.isNull().alias("passed"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def confidence(title: Column, doi_hit: Column, names: Column, passed: Column, jats: Column) -> Column:
    """How sure a full text is, at most 1 (M3)."""
    total = 0.5 * title + F.when(doi_hit, 0.2).otherwise(0.0) + 0.2 * names + F.when(passed, 0.25).otherwise(0.0) + F.when(jats, 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total), 3)


def filled(fields: list[Column]) -> Column:
    """How many fields aren't blank."""
    return sum((F.when(F.trim(X.text_of(f)) != "", 1).otherwise(0) for f in fields), F.lit(0))


def usable(core: list[Column]) -> Column:
    """Two of the core fields or more aren't blank."""
    return filled(core) >= 2


def weak(core: list[Column], failed: Column) -> Column:
    """Flagged as failed, or three of the core fields or more are blank."""
    return F.coalesce(failed, F.lit(False)) | (filled(core) <= len(core) - 3)


def passage_score(rank: Column, n_anchors: Column, n_words: Column, signal: Column) -> Column:
    """Score of a passage by its best rank, its density of numbers and its table signal (M2)."""
    density = n_anchors / F.greatest(n_words, F.lit(1))
    return W_RANK / (1.0 + rank) + W_ANCHOR * F.least(density * DENSITY, F.lit(1.0)) + W_TABLE * signal


def context_size(n_words: Column, reserved: int) -> Column:
    """Context for a text of so many words: a multiple of 512 above the need, within limits (M5)."""
    need = F.floor(n_words * WORDS_TO_TOKENS).cast("long") + reserved
    return F.greatest(F.lit(LEAST_CONTEXT), F.least(F.lit(MOST_CONTEXT), (F.floor(need / STEP).cast("long") + 1) * STEP))


def drift(value: Column, reference: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """WARN if a count is outside the band around its reference, INFO without one (M7)."""
    share = value / F.nullif(reference, F.lit(0))
    return F.when(share.isNull(), "INFO").when((share < low) | (share > high), "WARN").otherwise("OK")


def verifier_score(n_weak: Column) -> Column:
    """Ten less two for each weak field, at least 0 (M8)."""
    return F.greatest(F.lit(0), 10 - 2 * n_weak)


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two rectangles (x0, y0, x1, y1) share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side(0, 2) * side(1, 3)


def near_rank(values: Column, share: float = 0.95) -> Column:
    """The value at index floor(share * (n - 1)) of a sorted array, without interpolation."""
    return F.get(values, F.floor(F.lit(share) * (F.size(values) - 1)).cast("int"))


def malformed(value: Column, window: Column, located: Column) -> Column:
    """Rules by which a numeric anchor isn't a measurement, from the text around it."""
    w, plain = X.one_line(window), F.regexp_replace(value, r"\.", "\\\\.")
    has = lambda before, after: F.rlike(w, F.concat(F.lit(before), plain, F.lit(after)))
    n = lambda before, after: F.regexp_count(w, F.concat(F.lit(before), plain, F.lit(after)))
    section = has("^", r"\.?\s+[A-Z]") | (w.rlike(r"^\d+(?:\.\d+)*\.?\s+[A-Z]") & has(r"\b", r"\s+[A-Z][a-z]")) | (value.rlike(r"\d\.\d") & has(r"\bin\s+", r"\b"))
    alone = n(r"(?<!\d)(?<!\d[,.])", r"(?!\d)")
    rules = {
        "M2_SECTION_NUMBER": section,
        "M3_PSEUDOCODE_LINE": has(r"(?:^|\s)", r":\s+[A-Z]"),
        "M4_SUBTOKEN_OF_LONGER_NUMBER": (n("", "") > 0) & (alone == 0),
        "M5_VALUE_NOT_IN_TARGET_CHUNK": ~located,
        "M6_LICENCE_VERSION": w.rlike(r"(?i)licen[sc]ed under|Creative Commons") & value.rlike(r"^\d+\.\d+$"),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
