"""Quality rules: per-text counts and cross-document line frequency, in DataFrame functions only.

Base rules. Words are runs of `[^\\x20\\x09-\\x0D]`. A document fails them with fewer than 50 words, or when more than half
of its words stand in 3-word windows that its text holds twice or more.

Line frequency. A line is normalised to its lower-cased words joined by one blank; lines without a word don't count.
For each host (the column `source`), the distinct documents that hold a line are counted. With distinct="text" documents of
equal text count as one, so that plain copies (the business of deduplication) don't condemn their original; with
distinct="id" each doc_id counts. Lines in more than `limit` documents of a host are removed there, and a document is
rejected when less than `least_left` of its words remain.

Defined results: a null text is empty: 0 in every count and base_failed; a null host is the host ""; null ids are one
document where ids are counted; repeated rows each get their row; ties don't occur (limits are strict); an empty table
gives an empty one; texts of any length are taken whole, in memory proportional to the longest; other columns pass only
through clean(), whatever their names.

Scale: whole texts never move. A table of line hashes (12 bytes a line) is written once; counting shuffles (host, line,
text) triples that are pre-aggregated on the map side, so neither a hot host nor a hot line gathers in one task, and
the frequent lines join back by (host, line), which adaptive execution may split or broadcast by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoichion.llm.keys import field, packed, saved, text_key, workspace

#: Documents of a host that may hold a line, and the part of a document's words that must remain.
LIMIT, LEAST_LEFT = 100, 0.3
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"


def _repeated_words(df: DataFrame, words: str) -> DataFrame:
    """df with n_repeat_words: words in 3-word windows found twice or more.

    Windows are hashed; positions are sorted by whole hash, then position, so that equal windows are
    neighbours, which costs n log n for any text. Each step is a projection of its own, as lambdas would else evaluate
    the arrays that they look into anew for each element.
    """
    n, at = F.size(words), lambda a, i: F.get(a, i.cast("int"))
    df = df.withColumn("_win", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_dup", F.size(F.array_distinct("_win")) < F.size("_win"))
    placed = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i"))))
    df = df.withColumn("_placed", F.when(F.col("_dup"), placed))
    same = lambda x, j: F.coalesce(at("_placed", j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_pos", F.sort_array(F.transform(F.filter("_placed", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    step = F.transform("_pos", lambda p, k: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get("_pos", k + 1) - p, F.lit(3).cast("bigint"))))
    total = F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.when(F.col("_dup"), total).otherwise(F.lit(0).cast("bigint"))).drop("_win", "_dup", "_placed", "_pos")


def _line_hash(words: Column) -> Column:
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, _text (16 bytes that stand for the text), the base counts, and _lines: hash and number of words
    of each line with a word.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), text_key(full).alias("_text"), full.alias("_full"), F.split(full, "\n").alias("_raw"))
    df = df.withColumn("_lw", F.transform("_raw", lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))
    held = F.filter("_raw", lambda _, i: F.size(F.get("_lw", i)) > 0)
    df = df.select(
        "doc_id", "host", "_text",
        F.flatten("_lw").alias("_words"),
        (F.length("_full") - F.length(F.regexp_replace("_full", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        held.alias("_held"),
        F.transform(F.filter("_lw", lambda w: F.size(w) > 0), lambda w: F.struct(_line_hash(w).alias("h"), F.size(w).alias("n"))).alias("_lines"),
    )
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_dup_lines": (F.size("_held") - F.size(F.array_distinct("_held"))).cast("bigint"),
    })
    df = _repeated_words(df, "_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("doc_id", "host", "_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "_lines")


def frequent_lines(lines: DataFrame, limit: int) -> DataFrame:
    """(host, h) of lines in more than limit distinct documents of a host; lines: (host, h, what tells documents apart)."""
    return lines.distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > limit).select("host", "h")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, least_left: float = LEAST_LEFT, distinct: str = "text") -> DataFrame:
    """A row for each document: doc_id, host, _text, the base counts, base_failed, removed_lines (hashes of the lines that go),
    n_words_left and kept. distinct is "text" or "id".
    """
    if distinct not in ("text", "id"):
        raise ValueError(f"distinct must be text or id, not {distinct}")
    folder = workspace(docs.sparkSession, "line-rules")
    base = saved(counts(docs, doc_id, text, host), folder, "base")
    lines = base.select("host", "_text", "doc_id", F.explode(F.array_distinct("_lines.h")).alias("h"))
    # Written first, so that the join is between plain exchanges, whose hot partitions can be split.
    frequent = saved(frequent_lines(lines.select("host", "_text" if distinct == "text" else "doc_id", "h"), limit), folder, "frequent")
    gone = lines.drop("doc_id").join(frequent, ["host", "h"]).groupBy("host", "_text").agg(F.collect_set("h").alias("removed_lines"))
    df = base.join(gone, ["host", "_text"], "left").withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
    left = F.aggregate(F.filter("_lines", lambda x: ~F.array_contains("removed_lines", x["h"])), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    df = df.withColumn("n_words_left", F.when(F.size("removed_lines") == 0, F.col("n_words")).otherwise(left)).drop("_lines")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= F.lit(least_left) * F.col("n_words")))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, least_left: float = LEAST_LEFT, distinct: str = "text") -> DataFrame:
    """docs without rejected documents, frequent lines cut out of the texts that stay; its own columns only."""
    found = judge(docs, doc_id, text, host, limit, least_left, distinct).where("kept").groupBy("host", "_text").agg(F.first("removed_lines").alias("gone"))
    keyed = docs.select(packed(docs).alias("row"), F.coalesce(F.col(host), F.lit("")).alias("host"), text_key(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    full = field(text)
    stay = F.filter(F.split(full, "\n"), lambda x: ~F.array_contains("gone", _line_hash(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))))
    cut = F.when(F.size("gone") == 0, full).otherwise(F.array_join(stay, "\n"))
    return keyed.join(found, ["host", "_text"]).select(*((cut if c == text else field(c)).alias(c) for c in docs.columns))
