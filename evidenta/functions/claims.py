"""Functions over single claims. Those that need the order of matches or the places of words run as Arrow-batched functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenta.functions import text as X

#: Words that name a metric.
METRIC_WORDS = ("accuracy", "precision", "recall", "f1", "f-score", "dice", "iou", "auc", "auroc", "auprc", "bleu", "rouge", "meteor", "mae", "rmse", "mse", "mape", "nll", "perplexity", "mrr", "ndcg", "map", "hit", "em", "exact", "match", "correlation", "pearson", "spearman", "kappa", "sensitivity", "specificity", "score", "rate", "error", "loss", "latency", "throughput", "faithfulness")
#: Bounded metrics, on a scale of 0 to 1 or 0 to 100, and those that may be negative.
PERCENT = (
    "dice", "dice score", "dice coefficient", "dice index", "dsc", "f1", "f1 score", "f1-score", "f-score", "f score", "micro f1", "macro f1", "accuracy", "acc", "balanced accuracy", "top-1 accuracy", "top-5 accuracy", "precision", "recall", "iou", "miou", "jaccard", "jaccard index",
    "auroc", "auprc", "auc", "auc-roc", "roc-auc", "auc roc", "ap", "sensitivity", "specificity", "tpr", "tnr", "ndcg", "map", "mrr", "hit rate", "hits", "success rate", "pass rate", "pass@1", "bleu", "sacrebleu", "rouge", "rouge-l", "rouge-1", "rouge-2", "rougel", "meteor", "chrf", "ter", "exact match", "em", "ssim", "faithfulness", "relevance", "win rate", "coverage",
)
CORRELATION = ("pearson", "spearman", "kendall", "kendall tau", "kappa", "cohen kappa", "cohen's kappa", "correlation", "r2", "r^2", "r-squared", "matthews correlation", "mcc")
#: A suffix and a last word of a metric's name, what stands between a name and its number, and how near that is.
SUFFIX, LAST_WORD = r"\s*@\s*\d+|-\d+|-l\b|-1\b|-2\b", r"\s+(?:score|coefficient|index|rate|value)$"
BEHIND = r"^\s*(?:(?:of|is|was|reaches?|reached|at|=|:|~|>|<|>=|<=|about|around|nearly|up to)\s*)?(-?\d+(?:\.\d+)?)\s*%?"
AHEAD = r"(-?\d+(?:\.\d+)?)\s*%?\s*$"
NEAR_BEHIND, NEAR_AHEAD, EPSILON = 24, 14, 1e-6
#: Rows and subjects that are the paper's own, and the verbs behind a claim's subject.
OWN_ROW = r"\b(our[s]?|ours|proposed|the proposed|our method|our model|our approach|our system|this work|this paper|full model|full|w/o|ablation)\b"
SUBJECT = r"^\s*([A-Za-z][A-Za-z0-9\-/\.\+ ]{1,34}?)\s+(?:reports?|achiev\w*|obtain\w*|attain\w*|reach\w*|record\w*|get[s]?|scor\w*|yield\w*|produc\w*|show\w*|ha[sd]|deliver\w*|report\w+ (?:a|an)|=|:|of)\b"
#: Cues of a table's kind.
ABLATION = r"\bablat\w*|\bw/?o\b|\bwithout\b|\bw/\s|\bvs\.?\b|\bversus\b|leave[- ]one[- ]out|contribution of|effect of|impact of|role of|influence of|sensitivity (?:analysis|study|to)|component[- ]wise|removing |replacing |varying |different (?:choices|settings|values) of|design choice|with and without|w/ and w/o"
RESULTS = r"\b(main |overall |final |test[- ]set |benchmark )?results?\b|comparison (?:with|to|against|of)|compared (?:with|to)|state[- ]of[- ]the[- ]art|\bsota\b|leaderboard|performance (?:on|of|comparison)|we compare|against (?:prior|existing|baseline)|held[- ]out|official test"
OTHER = r"\bstatistics\b|\bdataset\b .*\b(size|split|counts?|composition)|hyper[- ]?parameters?|\bnotation\b|\bsymbols?\b|training (?:details|config|setup)|prompt template|\bexamples?\b (?:of|from)|qualitative|case stud|annotation guideline|(?:running|inference|training) time|complexity|#\s*params|parameter count|throughput|latency|related work|survey of"
#: Cues of own and of cited work.
OWN = (r"\b(we|our|us|ours)\b", r"\bthis (paper|work|study|approach|method|model|system|article)\b", r"\bin this (study|paper|work|article)\b", r"\bproposed (method|approach|model|system|framework|pipeline|architecture)\b", r"\bthe proposed\b")
STRONG_OWN = ("we propose", "we present", "we introduce", "we develop", "we design", "we build", "we evaluate our", "we report", "we conduct", "we perform", "our method", "our approach", "our model", "our framework", "our system", "our proposed", "our results", "our experiments", "our pipeline", "in this paper we", "in this work we", "this paper proposes", "this work proposes", "this study proposes", "we achieve", "we obtain")
OWN_TABLE = r"\b(table|fig\.?|figure)\s*\d+\s*(shows|presents|reports|summari[sz]es|illustrates|demonstrates|lists)\b"
CITATION = r"[A-Z][A-Za-z\-]+ et al\.?|\[\d{1,3}(?:\s*[,-]\s*\d{1,3})*\]|\((?:[A-Z][A-Za-z\-]+(?:\s+(?:et al\.?|and [A-Z][A-Za-z\-]+))?,?\s+)?\d{4}[a-z]?\)"
CITED = (r"\b(prior|previous|existing|earlier|related)\s+(work|works|method|methods|approach|approaches|study|studies|model|models|system|systems|literature)\b", r"\b(reported|achieved|obtained|proposed|introduced|developed) by\b", r"\bunlike\s+\[")
OWN_EARLIER = r"\b(our|we)\b[^.;]{0,30}?\b(prior|previous|earlier|recent|initial|past)\s+(work|works|study|studies|paper|papers|method|approach|model|version)\b"
ET_AL, IN_BRACKETS = r"\(?([A-Z][A-Za-z\-]+)\s+et al\.?(?:,?\s*\d{4}[a-z]?)?\)?", r"\(([A-Z][A-Za-z\-]+),?\s+\d{4}[a-z]?\)"
OWN_CAPTION = ("proposed", "our ", "ours", "full model", "complete model", "this work")
OWN_LINE, CITED_LINE = r"(proposed|ours|our |full model|complete|w/ all|all components)", r"(\[\d|[A-Z][A-Za-z\-]+ et al)"
OWN_SECTIONS = ("results", "experimental_setup", "method", "discussion", "conclusion", "abstract")

_NAMES = sorted((*PERCENT, *CORRELATION), key=len, reverse=True)
NAME = r"\b(" + "|".join(map(re.escape, _NAMES)) + rf")\b(?:{SUFFIX})?(?:\s+(?:score|coefficient|index|rate|value))?"
_NAME, _SUFFIX, _LAST, _BEHIND, _AHEAD = (re.compile(p, re.I) for p in (NAME, SUFFIX, LAST_WORD, BEHIND, AHEAD))
_LIMITS = {m: (0.0, 100.0) for m in PERCENT} | {m: (-100.0, 100.0) for m in CORRELATION}
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_CITATION, _ET_AL, _IN_BRACKETS = map(re.compile, (CITATION, ET_AL, IN_BRACKETS))
_OWN, _CITED = ([re.compile(p, re.I) for p in ps] for ps in (OWN, CITED))
_OWN_EARLIER, _OWN_TABLE, _TABULAR = re.compile(OWN_EARLIER, re.I), re.compile(OWN_TABLE, re.I), re.compile(r"\s*(table|fig\.?|figure)\s*\d", re.I)


def _metric(name: str) -> str | None:
    """Name in the table of limits of a metric as it is written; None if it isn't there without its suffix."""
    plain = _LAST.sub("", _SUFFIX.sub("", name.lower()).strip()).strip()
    return plain if plain in _LIMITS else None


def out_of_range(text: str | None) -> dict | None:
    """The first number that stands next to a bounded metric's name and is impossible for it (M4)."""
    text = text or ""
    for m in _NAME.finditer(text):
        metric = _metric(m[0])
        near = metric and (_BEHIND.match(text[m.end() : m.end() + NEAR_BEHIND]) or _AHEAD.search(text[max(0, m.start() - NEAR_AHEAD) : m.start()]))
        if near:
            low, high = _LIMITS[metric]
            if not low - EPSILON <= float(near[1]) <= high + EPSILON:
                return {"metric": metric, "value": float(near[1]), "low": low, "high": high}
    return None


def metric_names(text: str | None) -> list[str]:
    """Sorted words and names of metrics in a claim or a column's header; both are read by this one rule."""
    low = (text or "").lower()
    return sorted({*re.split(r"[^a-z0-9]+", low)} & {*METRIC_WORDS} | {x for m in _NAME.finditer(low) if (x := _metric(m[0]))})


def sentence_around(text: str, span: str, beside: int) -> str:
    """The sentence of `text` that the span begins in, with as many sentences on either side."""
    at = text.find(span) if span else -1
    if at < 0 and len(span) >= 8:
        at = text.find(span[:40])
    if at < 0:
        return span
    parts, end = _SENTENCE.split(text), 0
    for k, part in enumerate(parts):
        end += len(part) + 1
        if at < end:
            return " ".join(parts[max(0, k - beside) : k + beside + 1])
    return text[max(0, at - 220) : at + 220]


def without_own_citations(text: str, surnames: set[str]) -> str:
    """Text without what names earlier work of one's own: by the words, or by an author's name."""
    text = _OWN_EARLIER.sub(" ", text)
    for pattern in (_ET_AL, _IN_BRACKETS) if surnames else ():
        text = pattern.sub(lambda m: "" if m[1].lower() in surnames else m[0], text)
    return text


def strong_cues(text: str) -> int:
    """Cues in a section's text that it is about own work."""
    return sum(x in text.lower() for x in STRONG_OWN) + bool(_OWN_TABLE.search(text))


def attribution(context: str | None, span: str | None, kind: str | None, section: str | None, strong: int | None, names: list[str] | None) -> dict | None:
    """Whose result a span states: OWN_PAPER, CITED_PAPER or UNKNOWN, with confidence and level (G6, M6); null without a context.

    Levels are tried in order: the sentence with its neighbours, the block, the row of a table, the section, of which only the
    number of its cues is wanted (null: those of the context count).
    """
    if context is None:
        return None
    span = span or ""
    surnames = {x.split()[-1].lower() for x in names or () if x and x.split()}
    said = lambda who, confidence, level: {"attribution": who, "confidence": round(confidence, 2), "level": level}
    for window, base, level in ((sentence_around(context, span, 1), 0.6, "sentence"), (context, 0.5, "paragraph")):
        plain = without_own_citations(window, surnames)
        marked = bool(_CITATION.search(plain))
        own, cited = sum(bool(p.search(plain)) for p in _OWN), sum(bool(p.search(plain)) for p in _CITED) + marked
        mark, at = _CITATION.search(window), window.find(span[:20])
        if marked and span and mark and at >= 0 and abs(at - mark.start()) <= 70:  # a citation beside the number
            return said("CITED_PAPER", min(0.85, base + 0.15), level)
        if bool(own) != bool(cited):
            return said("OWN_PAPER" if own else "CITED_PAPER", min(0.9, base + 0.05 * (own + cited)), level)
    line = sentence_around(context, span, 0)
    if kind in ("table", "figure_caption") or _TABULAR.match(context):
        own_line = bool(re.match(OWN_LINE, line.strip().lower()))
        if re.match(CITED_LINE, line.strip()) and not own_line:
            return said("CITED_PAPER", 0.6, "table_row")
        if own_line and any(x in context[:400].lower() for x in OWN_CAPTION):
            return said("OWN_PAPER", 0.6, "table_row")
    strong = strong_cues(context) if strong is None else strong
    if section in OWN_SECTIONS and strong >= 2 and not _CITATION.search(line):
        return said("OWN_PAPER", 0.55, "section_subject")
    return said("UNKNOWN", 0.3, "exhausted")


def supporting_sentence(value: str | None, text: str | None) -> str | None:
    """The sentence of a text that supports a value best.

    One that holds it, else one with all its numbers, else the one with most of its words if half are there; else the text
    around the value's beginning, and at last the value itself. Null without a text.
    """
    if text is None:
        return None
    value = value or ""
    squeeze = lambda x: " ".join(x.lower().split())
    parts, plain = _SENTENCE.split(text), squeeze(value)
    numbers = {*re.findall(X.ANCHOR, value)}
    tokens = {t for t in re.findall(r"[a-z0-9][a-z0-9\-]*", value.lower()) if len(t) >= 4 and t not in X.STOP_WORDS}
    shared = lambda s: len(tokens & {*re.findall(r"[a-z0-9][a-z0-9\-]*", squeeze(s))})
    found = next((s for s in parts if plain and plain in squeeze(s)), None) or next((s for s in parts if numbers and all(n in s for n in numbers)), None)
    if not found and tokens:
        best = max(parts, key=shared)
        found = best if 2 * shared(best) >= len(tokens) else None
    if not found and plain and (at := squeeze(text).find(plain[:30])) >= 0:
        found = text[max(0, at - 140) : at + 200]
    return (found or value).strip()


def similarity(a: str | None, b: str | None) -> float:
    """Share of two texts that matching blocks cover, longest block first."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a or "", b or "").ratio()


_RANGE = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
_ATTRIBUTED = T.StructType([T.StructField("attribution", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("level", T.StringType())])

range_check = F.udf(out_of_range, _RANGE, useArrow=True)
metric_tokens = F.udf(metric_names, T.ArrayType(T.StringType()), useArrow=True)
attribute = F.udf(attribution, _ATTRIBUTED, useArrow=True)
support = F.udf(supporting_sentence, T.StringType(), useArrow=True)
ratio = F.udf(similarity, T.DoubleType(), useArrow=True)


def cues(c: Column) -> Column:
    """Cues in a section's text that it is about own work (strong_cues)."""
    low = F.lower(X.text_of(c))
    return sum((low.contains(x).cast("int") for x in STRONG_OWN), F.lit(0)) + X.text_of(c).rlike("(?iU)" + OWN_TABLE).cast("int")


def has_metric_word(c: Column) -> Column:
    """Whether a significant token of a text names a metric."""
    return F.size(F.array_intersect(X.sig_tokens(c), F.array(*map(F.lit, METRIC_WORDS)))) > 0


def sane(field: Column, value: Column) -> Column:
    """A dataset has a name; a metric or result has a digit or a word for a metric."""
    return F.when(field == "datasets", X.strip(value) != "").otherwise(X.text_of(value).rlike("(?U)\\d") | has_metric_word(value))


def subject(c: Column) -> Column:
    """What a claim is about, by the words before its verb; null if it is the paper's own work or isn't said."""
    found = X.strip(F.regexp_extract(X.text_of(c), "(?i)" + SUBJECT, 1))
    return F.when((found != "") & ~found.rlike("(?i)" + OWN_ROW), found)


def table_kind(caption: Column, headers: Column, rows: Column, metric_columns: Column) -> Column:
    """ablation, results or other, by caption, headers and rows of a table; cues of an ablation win."""
    whole = F.lower(F.concat_ws(" ", F.nullif(caption, F.lit("")), F.nullif(F.array_join(F.array_sort(headers), " "), F.lit("")), F.nullif(F.array_join(F.array_sort(rows), " "), F.lit(""))))
    cut = F.size(F.filter(rows, lambda r: r.rlike("(?i)" + ABLATION) | X.strip(r).rlike("^(-|−|w/o)")))
    ablated = (F.size(rows) > 0) & (cut >= F.greatest(F.lit(2), F.floor(F.size(rows) / 3)))
    return F.when(whole.rlike(ABLATION) | ablated, "ablation").when(whole.rlike(RESULTS), "results").when(whole.rlike(OTHER), "other").when((metric_columns > 0) & (F.size(rows) >= 2), "results").otherwise("other")
