"""Text functions as column expressions; all stay inside code generation or higher-order functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a title or claim.
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "using", "based", "our", "we", "of", "in", "on", "to", "a", "an", "is", "are", "was", "were", "by", "as", "data", "dataset", "datasets", "set", "sets")
#: Numeric anchor (a decimal number, or an integer of two digits or more), years, what stands before numbers that
#: only number something, and fragments of preprint ids.
ANCHOR = r"\d+\.\d+|\b\d{2,}\b"
YEAR = r"^(19|20)\d{2}$"
NUMBERED = r"(section|sec\.?|equation|eq\.?|figure|fig\.?|table|tab\.?|appendix|chapter|line|step|version|v)\s*$"
PREPRINT = r"\d{4}\.\d{4,5}$"
#: Characters before a number that are looked at, and those of them that the word before it may take.
BEFORE, BEFORE_WORD = 20, 14
#: White space as Unicode has it, as a class that Java and RE2 read alike.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: White space that isn't a single blank.
RUN = SPACE + "{2,}|(?! )" + SPACE
#: A line that holds only the heading of the back matter.
BACK_MATTER = r"(?iU)\n\s*(?:references|acknowledge?ments|bibliography)\s*\n"
#: A JSON object in a Markdown code fence.
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
#: Names of datasets.
DATASETS = (
    "FeTA", "BraTS", "ISIC", "CheXpert", "ChestX-ray14", "ACDC", "M&Ms", "ATLAS", "LIDC-IDRI", "MSD", "Medical Segmentation Decathlon", "MRBrainS", "OASIS", "ADNI", "CAMUS", "Kvasir", "PROMISE12", "WMH", "ISLES", "COVID-19-CT",
    "ImageNet", "COCO", "MS-COCO", "CIFAR-10", "CIFAR-100", "MNIST", "Fashion-MNIST", "PASCAL VOC", "Cityscapes", "KITTI", "nuScenes", "ADE20K", "Open Images", "CelebA", "LFW", "Places365", "SUN397", "Visual Genome",
    "SQuAD", "GLUE", "SuperGLUE", "IMDB", "SST-2", "CoNLL", "WMT", "MNLI", "CommonCrawl", "WikiText", "BookCorpus", "MS MARCO",
)
#: Phrases around the name of a dataset, and words that are none.
DATASET_PHRASES = (r"\bon\s+the\s+([A-Z][A-Za-z0-9\-]{1,24})\s+(?:dataset|benchmark|corpus)\b", r"\b([A-Z][A-Za-z0-9\-]{1,24})\s+(?:dataset|benchmark|corpus)\b", r"\b(?:evaluated|trained|tested)\s+on\s+(?:the\s+)?([A-Z][A-Za-z0-9\-]{1,24})\b")
#: Words of which each phrase has one; letters beyond ASCII that patterns take for ASCII ones, and those.
DATASET_CUES = (("dataset", "benchmark", "corpus"), ("dataset", "benchmark", "corpus"), ("evaluated", "trained", "tested"))
FOLDED, FOLDED_TO = "\u017f\u0131\u0130\u212a", "siik"
NO_DATASETS = ("The", "This", "Our", "These", "Both", "Each", "All", "Some", "Such", "Table", "Figure", "Section", "Results", "Method", "Methods", "Model", "Training", "Test", "Validation", "Proposed", "Public", "Standard")
#: Cues of empirical work.
EMPIRICAL = (
    r"\b(?:dataset|benchmark|corpus|survey|experiment|experimental|trial|cohort|participants?|subjects?|patients?|users?|responses?|interviews?)\b",
    r"\b(?:training|validation|test)\s+(?:set|split)\b",
    r"\b(?:accuracy|precision|recall|f1|dice|auc|mse|rmse|nll|bleu|rouge|mae|mape)\b",
    r"\b\d+\s+(?:participants?|subjects?|patients?|users?|responses?)\b",
)
#: Cues of biomedical and of computer-science texts.
BIOMEDICAL = r"\b(patients?|clinical|clinician|hospital|diagnos(is|tic)|prognos(is|tic)|treatment|therapy|in vitro|in vivo|ex vivo|assay|western blot|immunohistochem\w*|rt-?pcr|elisa|staining|antibod(y|ies)|mice|rats|murine|rodent|specimen|biopsy|serum|plasma|cohort|case report|retrospective|prospective|randomi[sz]ed|placebo|mg/kg|gestational|fetal|foetal|tumou?r|carcinoma|lesion|physiolog\w*|patholog\w*|histolog\w*)\b"
COMPUTING = r"\b(datasets?|benchmark|baselines?|state-of-the-art|sota|neural network|transformer|training set|test set|epochs?|fine-?tun\w*|pre-?train\w*|gpu|embeddings?|hyper-?parameter|ablation|backbone|inference time|leaderboard|precision-recall)\b"
#: Canonical sections by words of their labels, in order.
SECTIONS = (
    ("method", ("materials and methods", "methodology", "method", "methods", "approach")),
    ("experimental_setup", ("experimental setup", "experiments", "evaluation")),
    ("results", ("results", "findings")),
    ("introduction_related_work", ("related work", "prior work", "background", "introduction")),
    ("limitations", ("limitations", "threats to validity")),
    ("discussion", ("discussion", "analysis", "ablation")),
    ("conclusion", ("conclusion", "future work")),
    ("abstract", ("abstract",)),
    ("references", ("reference",)),
)
#: Headings by name and by number, and captions of tables.
HEADING_WORDS = ("abstract", "introduction", "background", "related work", "prior work", "materials and methods", "methods", "methodology", "approach", "method", "experimental setup", "experiments", "evaluation", "results", "findings", "discussion", "analysis", "ablation", "limitations", "threats to validity", "conclusion", "conclusions", "future work", "acknowledgements", "references")
NAMED_HEADING = r"(?i)^\s*(?:(?:\d+(?:\.\d+)*|[IVXivx]{1,5})\.?\s+)?(" + "|".join(HEADING_WORDS) + r")\b"
NUMBERED_HEADING = r"^\s*(?:\d+(?:\.\d+){0,2}|[IVX]{1,5})\.?\s+[A-Z][A-Za-z].{0,60}$"
TABLE_CAPTION = r"^\s*(?:[Tt][Aa][Bb][Ll][Ee]|[Tt][Aa][Bb]\.)\s*(?:\d+|[IVXLCivxlc]+)(?:\s*[.:]|\s*$|\s+[A-Z(\[])"
#: Phrases of the extraction prompts.
PROMPT_PHRASES = ("5-hour work session", "N participants over [duration/condition]", "authors' own simulation data", "device use dropped in the low-accessibility condition", "total work/leisure time was unchanged")
#: Short words that a query may have.
SHORT_WORDS = ("the", "and", "for", "with", "our", "we", "of", "in", "on", "to", "a", "an", "is", "are", "by", "as", "vs", "per", "no")
#: Quotes and dashes, and what they stand for in titles.
TITLE_SIGNS, TITLE_PLAIN = "’‘“”–—", "''\"\"--"
#: Characters that mark footnotes behind a value.
MARKERS = "*†‡§¶"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.array_remove(F.split(text_of(c), r"[ \t\n\r\f\x0B]+"), "")


def collapse(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), RUN, " "))


def one_line(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text_of(c), RUN, " "))


def strip(c: Column) -> Column:
    """White space at both ends removed."""
    ends = F.concat(F.substring(text_of(c), 1, 1), F.substring(text_of(c), -1, 1))  # most texts have none there
    return F.when(ends.rlike(SPACE), F.regexp_replace(text_of(c), rf"^{SPACE}+|{SPACE}+$", "")).otherwise(text_of(c))


def clean(c: Column) -> Column:
    """Cut at the first back-matter heading; three or more line ends to two, two or more blanks to one, trimmed."""
    body = F.split(text_of(c), BACK_MATTER, 2)[0]
    return strip(F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def json_object(c: Column) -> Column:
    """The JSON object in a text: all of it, else in a code fence, else from the first to the last brace (K4); null if none."""
    whole = F.trim(c)
    found = (whole, F.regexp_extract(whole, FENCED, 1), F.regexp_extract(whole, r"(?s)\{.*\}", 0))
    is_object = lambda x: F.json_object_keys(x).isNotNull()
    return F.coalesce(*(F.when(is_object(x) & F.try_parse_json(x).isNotNull(), x) for x in found))


def sentences(c: Column) -> Column:
    """Sentences, cut after . ! or ? and white space."""
    return F.filter(F.split(text_of(c), rf"(?<=[.!?]){SPACE}+"), lambda s: s != "")


def anchors(c: Column) -> Column:
    """All numeric anchors in order (F1)."""
    return F.regexp_extract_all(text_of(c), F.lit("(?U)" + ANCHOR), 0)


def valid_anchors(c: Column) -> Column:
    """(value, pos) of the anchors that state a quantity, at their offsets (F2).

    No year, no number inside square brackets or after the word of a numbered thing, and no part of a preprint id. All anchors
    are put between marks first; the texts between marks give each one's place and what stands before it.
    """
    mark = "\x01"
    t = F.translate(text_of(c), mark, " ")
    parts = F.split(F.regexp_replace(t, f"(?U)({ANCHOR})", f"{mark}$1{mark}"), mark)  # text, anchor, text, anchor, ..., text
    lengths = F.transform(parts, lambda x: F.length(x))
    each = F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(F.get(parts, i).alias("value"), F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x).alias("pos")))
    each = F.when(F.size(parts) > 2, each).otherwise(F.array().cast("array<struct<value:string,pos:int>>"))

    def good(x: Column) -> Column:
        before = F.substring(t, F.greatest(x["pos"] - BEFORE, F.lit(0)) + 1, F.least(x["pos"], F.lit(BEFORE)))
        near = F.substring(before, F.greatest(F.length(before) - BEFORE_WORD, F.lit(0)) + 1, F.lit(BEFORE_WORD))
        opened = F.regexp_extract(F.substring(t, F.lit(1), x["pos"]), r"([\[\]])[^\[\]]*$", 1)
        return ~x["value"].rlike(YEAR) & (opened != "[") & ~near.rlike("(?i)" + NUMBERED) & ~F.concat(before, x["value"]).rlike(PREPRINT)

    return F.filter(each, good)


def all_words(c: Column) -> Column:
    """Words of letters and digits, with inner hyphens, in lower case (the vocabulary of F6)."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"[a-z0-9][a-z0-9\-]*"), 0)


def sig_tokens(c: Column) -> Column:
    """Distinct tokens of four characters or more that aren't stop words."""
    return F.array_distinct(F.filter(all_words(c), lambda t: (F.length(t) >= 4) & ~t.isin(*STOP_WORDS)))


def title_tokens(c: Column) -> Column:
    """Distinct words of letters and digits of a title without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]+"), 0), lambda t: ~t.isin(*STOP_WORDS)))


def containment(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two token sets; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def title_similarity(a: Column, b: Column) -> Column:
    """Containment of the titles' tokens (F8)."""
    return containment(title_tokens(a), title_tokens(b))


def normal_title(c: Column) -> Column:
    """Plain quotes and dashes, white space collapsed, no full stop at the end, lower case (F22, for texts in NFKC)."""
    return F.lower(F.regexp_replace(one_line(F.translate(text_of(c), TITLE_SIGNS, TITLE_PLAIN)), r"\.$", ""))


def without_tag(c: Column) -> Column:
    """A title without a note in brackets at its end."""
    return strip(F.regexp_replace(text_of(c), r"\s*[\[\(][^\]\)]*[\]\)]\s*$", ""))


def numbers_normalised(c: Column) -> Column:
    """A number's text with plain minus, without white space, bold marks and footnote marks, in lower case."""
    plain = F.regexp_replace(F.translate(text_of(c), "−", "-"), rf"\*\*|__|{SPACE}|\x{{200B}}", "")
    return F.lower(F.regexp_replace(plain, f"[{MARKERS}]+$", ""))


def numeric_tokens(c: Column) -> Column:
    """Distinct whole unsigned numbers of a text; none inside a longer number or after a letter."""
    pieces = F.filter(F.split(text_of(c), SPACE + "+"), lambda x: x.rlike(r"(?U)\d"))
    found = F.transform(pieces, lambda x: F.regexp_extract_all(numbers_normalised(x), F.lit(r"(?U)(?<![\w.])(?:\d+(?:\.\d+)?|\.\d+)(?!\d|\.\d)"), 0))
    return F.array_distinct(F.flatten(found))


def claim_numbers(c: Column) -> Column:
    """The numeric tokens of a claim that have a point or two digits."""
    return F.filter(numeric_tokens(c), lambda t: t.contains(".") | (F.length(t) >= 2))


def empirical(c: Column) -> Column:
    """Whether a text shows signs of empirical work."""
    low = F.lower(text_of(c))
    return reduce(Column.__or__, (low.rlike(p) for p in EMPIRICAL)) & (strip(c) != "")


def domain(c: Column) -> Column:
    """biomed if four or more cues are biomedical and more than those of computing, else cs_ml."""
    count = lambda p: F.regexp_count(text_of(c), F.lit("(?i)" + p))
    return F.when((count(BIOMEDICAL) >= 4) & (count(BIOMEDICAL) > count(COMPUTING)), "biomed").otherwise("cs_ml")


def section(c: Column, default: str | None = None) -> Column:
    """Canonical name of a section's label: the first rule of SECTIONS that it meets."""
    low = F.lower(strip(c))
    out = F.lit(default) if default is not None else F.coalesce(F.nullif(F.substring(low, 1, 40), F.lit("")), F.lit("body"))
    for name, labels in reversed(SECTIONS):
        out = F.when(reduce(Column.__or__, (low.contains(x) for x in labels)), name).otherwise(out)
    return out


def is_heading(c: Column) -> Column:
    """Whether a line is a heading, by its words or by its number."""
    return text_of(c).rlike(NAMED_HEADING) | text_of(c).rlike(NUMBERED_HEADING)


def is_table_caption(c: Column) -> Column:
    """Whether a text begins as the caption of a table does (F16)."""
    return text_of(c).rlike(TABLE_CAPTION)


def dataset_names(c: Column) -> Column:
    """Sorted names of datasets: known ones, and others in the phrases around such names.

    A name in a phrase needs a digit or a second capital.
    """
    t = text_of(c)
    quoted = lambda n: "".join("\\" + x if not x.isalnum() and x != " " else x for x in n)
    # a name is looked for by its pattern only in texts that have its letters, which is far cheaper to see
    low = F.lower(F.translate(t, FOLDED, FOLDED_TO))
    # a variable of a lambda is worked out once
    known = F.transform(F.array(low), lambda x: F.array_compact(F.array(*(F.when(x.contains(n.lower()) & t.rlike(rf"(?iU)\b{quoted(n)}\b"), F.lit(n)) for n in DATASETS))))[0]
    none = F.array().cast("array<string>")
    said = F.flatten(F.array(*(F.when(reduce(Column.__or__, (t.contains(w) for w in ws)), F.regexp_extract_all(t, F.lit(p), 1)).otherwise(none) for p, ws in zip(DATASET_PHRASES, DATASET_CUES, strict=True))))
    named = F.filter(said, lambda x: ~x.isin(*NO_DATASETS) & (x.rlike("[0-9]") | x.rlike("[A-Z].*[A-Z]")))
    return F.array_sort(F.array_distinct(F.concat(known, named)))


def prompt_phrases(c: Column) -> Column:
    """The phrases of the extraction prompts that a text repeats."""
    low = F.lower(text_of(c))
    return F.array_compact(F.array(*(F.when(low.contains(p.lower()), F.lit(p)) for p in PROMPT_PHRASES)))


def good_query(c: Column, section_label: Column) -> Column:
    """Whether a text makes a query: two words or more, at least half of those of three letters real, no references."""
    found = F.regexp_extract_all(text_of(c), F.lit(r"[A-Za-z][A-Za-z\-]+"), 0)
    longer = F.filter(found, lambda w: F.length(w) >= 3)
    real = F.filter(longer, lambda w: (F.length(w) >= 4) | F.lower(w).isin(*SHORT_WORDS))
    return ~F.lower(text_of(section_label)).contains("reference") & (F.size(found) >= 2) & (2 * F.size(real) >= F.size(longer))


def flat(c: Column, kind: str) -> Column:
    """Text of a value: lists joined by "; ", maps as "k: v" (F25); empty for null."""
    if kind.startswith("array"):
        return F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x.cast("string")), "; ")
    if kind.startswith("map"):
        entries = F.map_entries(F.coalesce(c, F.create_map()))
        return F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"].cast("string"), e["value"].cast("string"))), "; ")
    return text_of(c.cast("string"))


def external_link(doi: Column, arxiv: Column) -> Column:
    """Link by DOI, else by preprint id, else null."""
    return F.coalesce(F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit(""))), F.concat(F.lit("https://arxiv.org/abs/"), F.nullif(arxiv, F.lit(""))))


def loops(c: Column, size: int = 60, step: int = 5, most: int = 5) -> Column:
    """Whether some window of `size` characters, taken every `step`, occurs more than `most` times in a text.

    Occurrences are counted without overlap, as the pieces that the window cuts the text into.
    """
    t = text_of(c)
    starts = F.when(F.length(t) >= size, F.sequence(F.lit(1), F.length(t) - size + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = lambda i: F.substring(t, i, F.lit(size))
    return F.exists(starts, lambda i: F.length(t) - F.length(F.replace(t, cut(i), F.lit(""))) > most * size)
