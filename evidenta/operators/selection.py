"""Selection of passages for a bounded context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenta.functions import scores as S
from evidenta.functions import text as X
from evidenta.functions.vectors import dot
from evidenta.operators.chunking import running_budget

#: Queries for papers that give none of their own.
QUERIES = ("problem statement research gap motivation background", "method approach study design procedure participants sample", "results findings outcomes performance evaluation", "dataset survey data collection measures instruments", "limitations discussion conclusion implications future work")
#: Limits of the selection.
PASSAGES, CHARS, PER_QUERY, SAME_ANCHOR, ALIKE, GENERIC_TOP, WORDS, METRICS = 10, 9000, 4, 2, 0.8, 50, 2500, 6
RESULT_HINTS = ("result", "experiment", "evaluation", "ablation", "performance", "comparison", "finding", "quantitative")
VERBS = r"(?i)\b(is|are|was|were|show|shows|achiev\w+|improv\w+|reach\w+|obtain\w+|report\w+|outperform\w+|propose\w+|present\w+)\b"
METRIC = r"(?i)\b(accuracy|precision|recall|f1(?:[- ]?score)?|dice(?:\s+(?:score|coefficient|index))?|iou|jaccard|mIoU|auroc|auprc|auc|sensitivity|specificity|hausdorff|hd95|nDCG(?:@\d+)?|MRR|MAP|exact match|EM|hit@\d+|recall@\d+|precision@\d+|p@\d+|BLEU(?:-\d)?|ROUGE(?:-[L\d]+)?|METEOR|perplexity|R?MSE|MAE|MAPE|WER|CER|PSNR|SSIM|pearson|spearman|kappa|correlation)\b"


def own_queries(chunks: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, query): queries that a paper's own metrics, result headings and captions make.

    `chunks` has paper, chunk_index, section, block_type and text. Of metrics the first six by the text are one query.
    """
    t = X.one_line(F.col("text"))
    found = chunks.select(paper, "chunk_index", F.posexplode(F.regexp_extract_all(X.text_of(F.col("text")), F.lit(METRIC), 0)).alias("at", "m"))
    first = found.groupBy(paper, F.lower("m").alias("low")).agg(F.min(F.struct("chunk_index", "at", "m")).alias("f"))
    six = first.withColumn("n", F.row_number().over(Window.partitionBy(paper).orderBy("f"))).where(F.col("n") <= METRICS)
    metrics = six.groupBy(paper).agg(F.array_sort(F.collect_list("f")).alias("f")).select(paper, F.concat(F.array_join(F.transform("f", lambda x: x["m"]), " "), F.lit(" results score table")).alias("query"))
    low, sec = F.lower(t), F.lower(X.text_of(F.col("section")))
    hinted = F.exists(F.array(*map(F.lit, RESULT_HINTS)), lambda h: low.contains(h) | sec.contains(h))
    heading = F.when((F.col("block_type") == "heading") & hinted, F.substring(t, 1, 120))
    caption = F.when(F.col("block_type").isin("table", "figure_caption"), F.substring(F.split(t, r"\. ")[0], 1, 120))
    blocks = chunks.select(paper, "section", F.coalesce(heading, caption).alias("query")).where(F.col("query").isNotNull() & X.good_query(F.col("query"), F.col("section"))).select(paper, "query")
    every = metrics.unionByName(blocks).where(X.good_query(F.col("query"), F.lit("")))
    return every.groupBy(paper, F.lower("query").alias("low")).agg(F.min("query").alias("query")).drop("low")


def best_ranks(vectors: DataFrame, queries: DataFrame, k: int, paper: str = "paper_id") -> DataFrame:
    """(paper, chunk_index, rank): the best rank from 0 of each chunk among the k nearest of any query of its paper.

    `vectors` has paper, chunk_index and vector, `queries` paper, query_no and query_vector.
    """
    scored = vectors.join(queries, paper).select(paper, "query_no", "chunk_index", dot(F.col("vector"), F.col("query_vector")).alias("score"))
    w = Window.partitionBy(paper, "query_no").orderBy(F.desc("score"), "chunk_index")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).groupBy(paper, "chunk_index").agg(F.min("rank").alias("rank"))


def table_signal(block_type: Column, text: Column, n_anchors: Column) -> Column:
    """1 for a table, 0.6 for a text of many numbers and hardly a verb, else 0."""
    verbs = F.regexp_count(F.substring(X.text_of(text), 1, 600), F.lit(VERBS))
    return F.when(block_type == "table", 1.0).when((n_anchors >= 6) & (verbs <= 1), 0.6).otherwise(0.0)


def greedy(candidates: DataFrame, paper: str = "paper_id", passages: int = PASSAGES, chars: int = CHARS) -> DataFrame:
    """(paper, chunk_index) of the candidates that are taken, best score first.

    A candidate is passed over, and the next one tried, if its text doesn't fit what is left of `chars` (the first always
    does), if over ALIKE of its numbers are those of one taken, or if SAME_ANCHOR taken ones share its most frequent number. A
    candidate has chunk_index, score, n_chars and anchors (in order). Which is taken depends on those before it: a fold over
    the paper's candidates, of which a paper has at most as many as its queries name.
    """
    item = "struct<chunk_index:int,anchors:array<string>,main:string,n_chars:int>"
    counts = F.transform(F.array_distinct("anchors"), lambda a: F.struct((-F.size(F.filter("anchors", lambda x: x == a))).alias("n"), F.array_position("anchors", a).alias("at"), a.alias("a")))
    main = F.array_min(counts)["a"]
    each = candidates.select(paper, F.struct((-F.col("score")).alias("below"), F.col("chunk_index").cast("int").alias("chunk_index"), F.array_distinct("anchors").alias("anchors"), main.alias("main"), F.col("n_chars").cast("int").alias("n_chars")).alias("c"))
    ordered = each.groupBy(paper).agg(F.array_sort(F.collect_list("c")).alias("cs"))

    def take(a: Column, x: Column) -> Column:
        used = F.aggregate(a, F.lit(0), lambda n, y: n + y["n_chars"])
        alike = F.exists(a, lambda y: F.size(F.array_intersect(x["anchors"], y["anchors"])) > ALIKE * F.size(x["anchors"]))
        shared = F.size(F.filter(a, lambda y: F.coalesce(y["main"] == x["main"], F.lit(False))))
        ok = (F.size(a) < passages) & ((F.size(a) == 0) | (used + x["n_chars"] <= chars)) & ~((F.size(x["anchors"]) > 0) & alike) & ~(x["main"].isNotNull() & (shared >= SAME_ANCHOR))
        return F.when(ok, F.concat(a, F.array(F.struct(x["chunk_index"].alias("chunk_index"), x["anchors"].alias("anchors"), x["main"].alias("main"), x["n_chars"].alias("n_chars"))))).otherwise(a)

    taken = F.aggregate("cs", F.array().cast(f"array<{item}>"), take)
    return ordered.select(paper, F.explode(taken).alias("c")).select(paper, "c.chunk_index")


def content_aware(chunks: DataFrame, ranks: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, chunk_index) chosen by score from the chunks that the paper's queries name."""
    named = ranks.join(chunks, [paper, "chunk_index"]).withColumn("anchors", F.transform(X.valid_anchors(F.col("text")), lambda x: x["value"]))
    n = F.size("anchors")
    score = S.passage_score(F.col("rank"), n, F.size(X.words(F.col("text"))), table_signal(F.col("block_type"), F.col("text"), n))
    return greedy(named.select(paper, "chunk_index", score.alias("score"), F.length("text").alias("n_chars"), "anchors"), paper)


def select(chunks: DataFrame, legacy: DataFrame, aware: DataFrame | None = None, budget: int = WORDS, paper: str = "paper_id") -> DataFrame:
    """(paper, chunk_index, mode, before, take): what of each paper's chunks goes into its context of `budget` words.

    A paper that fits passes through. Others take the chunks of `aware`, if it is given and the chunks have block types, or of
    `legacy`, in order; a paper of which none is chosen takes all.
    """
    grounded = aware is not None and "block_type" in chunks.columns
    chosen = (aware if grounded else legacy).select(paper, "chunk_index").distinct().withColumn("chosen", F.lit(True))
    own = Window.partitionBy(paper)
    sized = chunks.withColumn("n_words", F.size(X.words(F.col("text")))).join(chosen, [paper, "chunk_index"], "left")
    marked = sized.withColumn("fits", F.sum("n_words").over(own) <= budget).withColumn("any", F.max("chosen").over(own).isNotNull())
    name = "content_aware" if grounded else "legacy" if aware is None else "legacy_fallback"
    kept = marked.where(F.col("fits") | F.col("chosen") | ~F.col("any")).withColumn("mode", F.when(F.col("fits"), "passthrough").otherwise(name))
    return running_budget(kept.select(paper, "chunk_index", "mode", "n_words"), paper, ["chunk_index"], "n_words", budget).select(paper, "chunk_index", "mode", "before", "take")


def compare(old: DataFrame, new: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, n_old, n_new, shared, latest): how two selections of chunks differ."""
    both = old.select(paper, "chunk_index", F.lit(1).alias("o")).join(new.select(paper, "chunk_index", F.lit(1).alias("n")), [paper, "chunk_index"], "full")
    return both.groupBy(paper).agg(F.count("o").alias("n_old"), F.count("n").alias("n_new"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("shared"), F.max(F.when(F.col("n").isNotNull(), F.col("chunk_index"))).alias("latest"))

