"""Ranked hits → one answer per query: extractive text, prompt, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from duoglot.functions.text import citation_tag, strip

# Texts and limits of the answer.
NOTHING_FOUND = "No matching passages found for: "
ANSWER_HEADER = "Extractive bilingual answer (context-stitched)"
SUMMARY_TITLE = "Summary:"
CITATIONS_TITLE = "Citations:"
PROMPT_LANGUAGE = "Answer in "
PROMPT_RULE = ". Use only the context and cite [book_id:para_id]."
PROMPT_QUESTION = "Question: "
PROMPT_CONTEXT = "Context:"
SUMMARY_CHARS = 600
ANSWER_BLOCKS = 6
CITATIONS = 10
ELLIPSIS = "…"

# A text generator plug-in: prompt → answer.
Generator = Callable[[Column], Column]

CITATION_COLUMNS = ("rank", "doc_id", "book_id", "para_id", "pali_paragraph",
                    "translation_paragraph", "snippet", "score", "score_type")


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _by_rank(value: Column, keep: Column) -> Column:
    """The kept values of a query, ordered by rank."""
    rows = F.sort_array(F.collect_list(F.when(keep, F.struct("rank", value.alias("value")))))
    return F.transform(rows, lambda r: r["value"])


def _shortened(summary: Column) -> Column:
    """Over-long text is cut, loses its last (partial) word and gets an ellipsis."""
    cut = F.regexp_replace(F.substring(summary, 1, SUMMARY_CHARS), r" [^ ]*\z", "")
    return F.when(F.length(summary) > SUMMARY_CHARS, F.concat(cut, F.lit(ELLIPSIS))).otherwise(
        summary)


def assemble_answers(queries: DataFrame, hits: DataFrame,
                     generator: Generator | None = None) -> DataFrame:
    """``(query_id, lang, answer, prompt, citations)`` for ``(query_id, query, query_lang)``.

    A summary is stitched from the first hits until it is long enough; a running length
    over the hits before the current one tells whether it still belongs. Window and
    aggregation share one shuffle by query, and a query has at most ``top_k`` hits. With a
    ``generator`` the answer is what it makes of the prompt.
    """
    rank = F.col("rank")
    primary = strip(F.coalesce(F.nullif(F.col("translation_paragraph"), F.lit("")),
                               F.col("pali_paragraph"), F.lit("")))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = hits.drop("query_lang").join(
        queries.select("query_id", "query_lang"), "query_id").withColumns({
            "primary": primary, "tag": citation_tag(),
            "pali": _text("pali_paragraph"), "translation": _text("translation_paragraph")})
    rows = rows.withColumn("length_before", F.coalesce(
        F.sum(F.length("primary")).over(before), F.lit(0)))

    pali_first = F.col("query_lang") == "pali"
    first = F.when(pali_first, F.col("pali")).otherwise(F.col("translation"))
    second = F.when(pali_first, F.col("translation")).otherwise(F.col("pali"))
    shown = rank <= ANSWER_BLOCKS
    in_summary = (shown & (F.col("length_before") < SUMMARY_CHARS) & (F.col("primary") != ""))
    block = F.concat("tag", F.lit("\n"), first, F.lit("\n"), second, F.lit("\n"))
    context = F.concat("tag", F.lit(" "), F.concat_ws(
        " / ", F.nullif(F.col("pali_paragraph"), F.lit("")),
        F.nullif(F.col("translation_paragraph"), F.lit(""))))

    grouped = rows.groupBy("query_id").agg(
        F.array_join(_by_rank(F.col("primary"), in_summary), " ").alias("summary"),
        F.array_join(_by_rank(block, shown & ((first != "") | (second != ""))), "\n")
        .alias("blocks"),
        F.array_join(_by_rank(context, F.lit(True)), "\n\n").alias("context"),
        F.slice(F.sort_array(F.collect_list(F.struct(*CITATION_COLUMNS))), 1, CITATIONS)
        .alias("citations"))

    extractive = F.concat(
        F.lit(f"{ANSWER_HEADER}\n\n{SUMMARY_TITLE}\n"), _shortened(F.col("summary")),
        F.lit(f"\n\n{CITATIONS_TITLE}\n"), F.col("blocks"))
    prompt = F.concat(
        F.lit(PROMPT_LANGUAGE), F.col("query_lang"), F.lit(f"{PROMPT_RULE}\n\n{PROMPT_QUESTION}"),
        F.col("query"), F.lit(f"\n\n{PROMPT_CONTEXT}\n"), F.coalesce("context", F.lit("")),
        F.lit("\n"))
    nothing = F.concat(F.lit(NOTHING_FOUND), F.col("query"))
    answers = queries.select("query_id", "query", "query_lang").join(
        grouped, "query_id", "left").withColumn("prompt", prompt)
    if generator is None:
        text = F.coalesce(extractive, nothing)
    else:
        text = generator(F.col("prompt"))
    empty = F.array().cast(answers.schema["citations"].dataType)
    return answers.select(
        "query_id", F.col("query_lang").alias("lang"), text.alias("answer"), "prompt",
        F.coalesce("citations", empty).alias("citations"))


def display_texts(hits: DataFrame) -> DataFrame:
    """``hit_label`` and ``citation_text``: how a hit is shown in a list of results."""
    blank = F.lit("")
    return hits.withColumns({
        "hit_label": F.concat(citation_tag(), F.lit(" · doc="), F.col("doc_id")),
        "citation_text": F.concat(
            citation_tag(), F.lit("\n"), F.coalesce("pali_paragraph", blank), F.lit("\n"),
            F.coalesce("translation_paragraph", blank))})
