"""Quality rules: divergence of a text's histograms from its language's.

Each text has a histogram of character classes and one of the common words of its
language. Both are compared with the histograms of the whole language by
Jensen-Shannon distance. Texts that are too short for a histogram to say anything are
not judged by it. The common words are the most frequent short words of a language in
the corpus itself, counted over all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep.llm.common import words, written

#: Words in the histogram of a language, and the most letters of a word that may be
#: one: function words are short, and short words are few, so counting them all is cheap.
COMMON_WORDS = 24
COMMON_LETTERS = 4
SHORT_WORD = f"^\\p{{L}}{{1,{COMMON_LETTERS}}}$"
#: Documents with text from which on a language has a reference of its own. A document of
#: no language is held against the nearest reference there is, one of a language with fewer
#: documents as well, but only for its characters: its words are not that language's.
MIN_DOCS = 10
#: A distance above which a histogram is not that of the language, and the least
#: number of characters or words at which that is asked.
MAX_CLASS_DISTANCE = 0.25
MIN_CHARS = 300
MAX_WORD_DISTANCE = 0.45
MIN_WORDS = 40
#: All other words are one part of the histogram, so the distance of a text without any
#: common word stays below the limit where these cover less than a third of a language.
#: Their lack is therefore judged by itself: less than this part of the language's share
#: of them, and fewer than chance explains, by so many standard deviations.
MIN_COMMON_PART = 1 / 3
LACK_DEVIATIONS = 3

#: The base rules.
MIN_BASE_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

_COUNTED = ["_upper", "_digit", "_blank", "_mark", "_sign"]
_CLASSES = [*_COUNTED, "_rest"]


def _count(text: Column, others: str) -> Column:
    """Characters left when ``others`` are taken out."""
    return F.length(F.regexp_replace(text, others, ""))


def class_counts(thin: Column) -> list[Column]:
    """Upper case letters, digits, blanks, marks of a sentence and other signs of a thinned text."""
    return [
        _count(thin, r"\P{Lu}+").alias("_upper"),
        _count(thin, r"[^0-9]+").alias("_digit"),
        _count(thin, r"[^\x20\x09-\x0D]+").alias("_blank"),
        _count(thin, r"""[^.,;:'"?\-]+""").alias("_mark"),
        _count(thin, r"[^!#$%&()*+/<=>@\[\\\]^_`{|}~]+").alias("_sign"),
        _count(thin, r"[^#*$%&|<>]+").alias("_symbols"),
    ]


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance, in bits, of two arrays of shares."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(left, right, lambda p, q: part(p, q) + part(q, p))
    total = F.aggregate(terms, F.lit(0.0), lambda sum_, term: sum_ + term)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _shared_starts(ordered: Column) -> Column:
    """Places, in order, whose hash has an equal neighbour in an array sorted by (h, k)."""

    def place(x: Column, k: Column) -> Column:
        equal = (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"])
        return F.when(equal, x["k"])

    return F.array_sort(F.filter(F.transform(ordered, place), lambda k: k.isNotNull()))


def signals(docs: DataFrame, id_col: str, text_col: str, lang_col: str, keep: list[str] | None = None) -> DataFrame:
    """What the rules look at, one row for each input row, and what is kept of it.

    ``_short`` has the text's words of few letters, lower-cased.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(name) for name in keep or [id_col]])
    rows = docs.select(row.alias("_row"), lang.alias("_lang"), text.alias("_text"))
    # Small letters are most of a text and none of the classes that are counted: without
    # them the counts read a fifth of it.
    rows = rows.select(
        "_row",
        "_lang",
        "_text",
        words(F.col("_text")).alias("_words"),
        F.regexp_replace("_text", r"[a-z\p{Ll}]+", "").alias("_thin"),
    )
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    short = F.transform(F.filter("_words", lambda word: F.length(word) <= COMMON_LETTERS), lambda word: F.lower(word))
    rows = rows.select(
        "_row",
        "_lang",
        F.size("_words").alias("_n"),
        F.length("_text").alias("_chars"),
        F.length(F.array_join("_words", "")).alias("_word_chars"),
        *class_counts(F.col("_thin")),
        lines.alias("_lines"),
        F.transform("_words", lambda word: F.xxhash64(word)).alias("_hashes"),
        short.alias("_short"),
    )
    places = F.when(F.col("_n") >= WINDOW, F.sequence(F.lit(0), F.col("_n") - WINDOW))
    window = F.transform(places, lambda k: F.xxhash64(*[F.get("_hashes", k + j) for j in range(WINDOW)]))
    rows = rows.select(
        *[name for name in rows.columns if name not in ("_lines", "_hashes")],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup_lines"),
        F.coalesce(window, F.array().cast("array<bigint>")).alias("_windows"),
    )
    twice = F.size("_windows") > F.size(F.array_distinct("_windows"))
    # A column of its own: a lambda would work an expression out again for each element.
    numbered = F.transform("_windows", lambda h, k: F.struct(h.alias("h"), k.alias("k")))
    rows = rows.select(
        *[name for name in rows.columns if name != "_windows"],
        F.when(twice, F.array_sort(numbered)).alias("_ordered"),
    )
    starts = F.coalesce(_shared_starts(F.col("_ordered")), F.array().cast("array<int>"))
    rows = rows.select(*[name for name in rows.columns if name != "_ordered"], starts.alias("_starts"))
    # Neighbouring windows share words: each adds those up to the next one's start.
    gaps = F.transform(
        "_starts",
        lambda start, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1), start + WINDOW) - start),
    )
    repeat = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)
    rest = sum((-F.col(name) for name in _COUNTED), F.col("_chars"))
    return rows.select(
        *[name for name in rows.columns if name != "_starts"], rest.alias("_rest"), repeat.alias("_repeat")
    )


def references(rows: DataFrame) -> DataFrame:
    """One row for each language: ``_lang``, ``_docs``, ``_common``, ``_q_words``, ``_q_classes``.

    ``rows`` are signals. A row holds ``COMMON_WORDS`` short words at most. The row with an
    empty ``_lang`` is made of all texts.
    """
    # Texts count alike for the classes, so that a few long odd ones don't set the
    # reference; whole parts per million keep the sums free of the order of addition.
    parts = [F.floor(F.col(name).cast("long") * 1_000_000 / F.col("_chars")).alias(name) for name in _COUNTED]
    some = rows.where("_chars > 0")
    sums = some.select("_lang", "_n", *parts, F.lit(1_000_000).cast("long").alias("_chars")).groupBy("_lang").agg(
        F.count(F.lit(1)).alias("_docs"), *[F.sum(name).alias(name) for name in ("_n", *_COUNTED, "_chars")]
    )
    counted = rows.select("_lang", F.explode("_short").alias("_word")).groupBy("_lang", "_word")
    counted = counted.agg(F.count(F.lit(1)).alias("_times")).where(F.col("_word").rlike(SHORT_WORD))
    # Small from here on: rows for languages, and for their short words.
    sums, counted = written(sums, "sums"), written(counted, "words")
    own_and_all = F.explode(F.array_distinct(F.array(F.col("_lang"), F.lit("")))).alias("_lang")
    words_of = counted.select(own_and_all, "_word", "_times").groupBy("_lang", "_word")
    words_of = words_of.agg(F.sum("_times").alias("_times"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_times"), "_word"))
    best = words_of.withColumn("_place", place).where(F.col("_place") <= COMMON_WORDS)
    best = best.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("_place", "_word", "_times"))).alias("_best"))
    names = ["_docs", "_n", *_COUNTED, "_chars"]
    totals = sums.select(own_and_all, *names).groupBy("_lang").agg(*[F.sum(name).alias(name) for name in names])
    rest = sum((-F.col(name) for name in _COUNTED), F.col("_chars"))
    found = totals.withColumn("_rest", rest).join(best, "_lang", "left")
    best_words = F.coalesce(F.col("_best"), F.array().cast("array<struct<_place:int,_word:string,_times:bigint>>"))
    times = F.transform(best_words, lambda b: b["_times"].cast("double") / F.greatest(F.col("_n"), F.lit(1)))
    return found.select(
        "_lang",
        "_docs",
        F.transform(best_words, lambda b: b["_word"]).alias("_common"),
        _with_rest(times).alias("_q_words"),
        _class_shares().alias("_q_classes"),
    )


def _with_rest(parts: Column) -> Column:
    """Shares of the common words, and last that of all others."""
    known = F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)
    return F.concat(parts, F.array(F.greatest(1.0 - known, F.lit(0.0))))


def _class_shares() -> Column:
    chars = F.greatest(F.col("_chars"), F.lit(1)).cast("double")
    return F.array(*[F.col(name) / chars for name in _CLASSES])


def _word_shares(common: Column) -> Column:
    """Shares of the common words in a text's words."""
    size = F.size("_short")
    whole = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    return F.transform(common, lambda word: (size - F.size(F.array_remove("_short", word))) / whole)


def _with_reference(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Signals with the reference of their language, or else the nearest of all languages' own.

    ``_worded`` says whether the reference has anything to say of a text's words. Where no
    language has enough documents, all texts together are the only reference.
    """
    names = ["_common", "_q_words", "_q_classes"]
    has_own = (F.col("_lang") != "") & (F.col("_docs") >= MIN_DOCS)
    one = F.struct("_lang", *names)
    # One row of all references, only for documents without one of their own.
    others = known.agg(
        F.array_sort(F.collect_list(F.when(has_own, one))).alias("_refs"),
        F.collect_list(F.when(F.col("_lang") == "", one)).alias("_mix"),
    ).select(F.when(F.size("_refs") > 0, F.col("_refs")).otherwise(F.col("_mix")).alias("_refs"))
    # Left to adaptive execution: the references grow with the languages.
    rows = rows.join(known.where(has_own).select("_lang", *names), "_lang", "left")
    rows = rows.join(F.broadcast(others), F.col("_q_classes").isNull(), "left")

    def away(ref: Column) -> Column:
        apart = distance(F.col("_classes"), ref["_q_classes"])
        apart += distance(_with_rest(_word_shares(ref["_common"])), ref["_q_words"])
        return F.struct(apart.alias("_apart"), *[ref[name].alias(name) for name in ("_lang", *names)])

    alone = F.col("_q_classes").isNull()
    rows = rows.withColumn("_classes", _class_shares())
    rows = rows.withColumn("_nearest", F.when(alone, F.array_min(F.transform("_refs", away))))
    return rows.select(
        *[name for name in rows.columns if name not in (*names, "_refs", "_nearest")],
        (~alone | (F.col("_lang") == "")).alias("_worded"),
        *[F.coalesce(F.col(name), F.col("_nearest")[name]).alias(name) for name in names],
    )


def _lacks_common_words() -> Column:
    """Whether a text has too few of its language's common words for its length."""
    share, whole = F.col("common_share"), F.col("lang_common_share")
    lack = (whole - share) * F.sqrt("n_words")
    return (share < MIN_COMMON_PART * whole) & (lack > LACK_DEVIATIONS * F.sqrt(whole))


def judge(docs: DataFrame, id_col: str, text_col: str, lang_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (what is kept of it), the counts, distances and verdicts.

    A null text is an empty one, a null language one without a reference of its own, as a
    language with fewer than ``MIN_DOCS`` documents: see there for what they are held against.
    A text with fewer than 20 words, or more than 30 percent of its words in repeated
    windows of eight, fails the base rules. Of the others, a text is dropped whose
    character classes (from 300 characters on) or common words (from 40 words on) are
    farther from the language's than the limits, or that lacks the common words; shorter
    texts are kept, and what counts as a lack follows from a text's length. Repeated rows
    are judged one by one, an empty table gives an empty result, other columns of the
    input play no part.
    """
    # Counts and short words are written, texts are not.
    rows = written(signals(docs, id_col, text_col, lang_col), "signals")
    # One short row for each language; its size does not grow with the documents.
    known = written(references(rows), "references")
    if keep is not None:
        # Whole rows: reading the texts again costs less than writing and moving them.
        rows = signals(docs, id_col, text_col, lang_col, keep)
    rows = _with_reference(rows, known).select(
        "_row", "_n", "_word_chars", "_symbols", "_dup_lines", "_repeat", "_chars", "_q_words", "_q_classes",
        F.when(F.col("_worded"), _word_shares(F.col("_common"))).alias("_shares"), "_classes",
    )
    rows = rows.select(
        F.col("_row").alias("row"),
        F.col("_n").cast("long").alias("n_words"),
        F.col("_word_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.col("_chars").alias("n_chars"),
        distance(F.col("_classes"), F.col("_q_classes")).alias("class_distance"),
        distance(_with_rest(F.col("_shares")), F.col("_q_words")).alias("word_distance"),
        F.aggregate("_shares", F.lit(0.0), lambda total, share: total + share).alias("common_share"),
        (1.0 - F.element_at("_q_words", -1)).alias("lang_common_share"),
    )
    base = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    odd = ((F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    near = ~base & ~F.coalesce(odd, F.lit(False))
    lack = (F.col("n_words") >= MIN_WORDS) & _lacks_common_words()
    kept = near & ~F.coalesce(lack, F.lit(False))
    # Behind a generator of one row: a filter on the verdict would else be moved down to
    # the texts, with all that the verdict hangs on worked out again inside it.
    return rows.withColumn("base_failed", base).select("*", F.explode(F.array(kept)).alias("kept"))
