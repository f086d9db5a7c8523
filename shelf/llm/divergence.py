"""Quality rules by distribution divergence.

A document's characters fall into classes and its words, which are its runs of letters in any case, into common words
and the rest. Both histograms are compared with those of the document's language by Jensen-Shannon distance (0 to 1). A language's histograms are summed over all
of its documents that pass the base rules, so they are learnt from the whole corpus; a language that is not listed is
compared with all listed ones together. A histogram of too few characters or words says nothing and is not compared.

Only Spark SQL functions are used. What reaches the driver is one row of counts for each listed language.

Defined results: NULL, empty and blank texts have no words, so the base rules fail them. Without any document that
passes the base rules there is nothing to compare with and every document that passes them is kept. Repeated rows count
one by one and give equal rows. Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.llm.common import let, words
from shelf.scratch import materialize

#: fixed values: very common words of four languages
COMMON_WORDS = {
    "en": "the of and to in a is that for it was with as on be by at this are or from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo".split(),
}
#: character classes besides lower-case letters and white space; what fits none is the last class
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stops": r"[.,;:?'\"()-]", "symbols": r"[#*$%&|<>]"}


def repeated_window_words(word_list: Column, window: int = 8) -> Column:
    """The number of words that lie in a window of ``window`` words found at least twice in the list."""

    def covered(starts: Column) -> Column:
        own = F.transform(starts, lambda s, at: F.least(F.lit(window), F.coalesce(F.get(starts, at + 1) - s, F.lit(window))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, n: total + n)

    def twice(ordered: Column) -> Column:
        start = lambda x, at: F.when(
            (x["hash"] == F.get(ordered, at - 1)["hash"]) | (x["hash"] == F.get(ordered, at + 1)["hash"]), x["at"]
        )
        return F.array_sort(F.filter(F.transform(ordered, start), lambda x: x.isNotNull()))

    def count(runs: Column) -> Column:
        ordered = F.array_sort(F.transform(runs, lambda h, at: F.struct(h.alias("hash"), at.alias("at"))))
        # most texts repeat no window: they are done after one set of hashes
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("long")).otherwise(
            let(let(ordered, twice), covered)
        )

    def runs(hashes: Column) -> Column:
        here = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (window - 1), F.lit(0)))
        return F.transform(here, lambda h, at: F.xxhash64(h, *(F.get(hashes, at + j) for j in range(1, window))))

    return let(let(F.transform(word_list, lambda w: F.xxhash64(w)), runs), count)


def base_counts(documents: DataFrame, *more: str) -> DataFrame:
    """The base rules' counts of every document, and its histograms as columns ``c0..`` and ``w0..``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", r"\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    listed = sorted({w for known in COMMON_WORDS.values() for w in known})
    # each generator below makes one row a document and keeps what it holds from being worked out twice
    rows = documents.select("doc_id", *more, text.alias("t"))
    rows = rows.select("*", F.explode(F.array(words(F.col("t")))).alias("words"))
    # one pass over the text leaves the few characters that the classes tell apart
    rows = rows.select("*", F.explode(F.array(F.regexp_replace("t", r"[\p{Ll}\s]+", ""))).alias("marks"))
    rows = rows.select("*", F.explode(F.array(F.array_remove(F.split("t", r"[^\p{L}]+"), ""))).alias("plain"))
    # common words in one string, each between two blanks of its own: a word is counted by what the string loses without it
    common = F.lower(F.array_join(F.filter("plain", lambda w: F.lower(w).isin(listed)), "  "))
    rows = rows.select("*", F.explode(F.array(F.concat(F.lit(" "), common, F.lit(" ")))).alias("common"))
    uses = lambda w: (F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)
    n_words, chars = F.size("words").cast("long"), F.length("t").cast("long")
    word_chars = F.length(F.array_join("words", "")).cast("long")
    fits = lambda pattern: (F.length("marks") - F.length(F.regexp_replace("marks", pattern, ""))).cast("long")
    counted = rows.select(
        "doc_id", *more,
        n_words.alias("n_words"),
        word_chars.alias("word_chars"),
        fits(CLASSES["symbols"]).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        chars.alias("chars"),
        F.size("plain").cast("long").alias("letter_words"),
        (word_chars - F.length("marks")).alias("c0"),  # lower-case letters
        (chars - word_chars).alias("c1"),  # white space
        *(fits(p).alias(f"c{n}") for n, p in enumerate(CLASSES.values(), 2)),
        *(uses(x).cast("long").alias(f"w{n}") for n, x in enumerate(listed)),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _shares(counts: Sequence[Column], total: Column) -> Column:
    """Counts and what is left of the total, as shares of it."""
    rest = total - sum(counts[1:], counts[0])
    return F.transform(F.array(*counts, rest), lambda n: n / F.greatest(total, F.lit(1)))


def distance(shares: Column, reference: Sequence[float]) -> Column:
    """Jensen-Shannon distance to the base 2 between a document's shares and a reference."""

    def part(p: Column, q: Column) -> Column:
        # p log(p / m) + q log(q / m), with m their mean and 0 log 0 = 0
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    known = F.array(*map(F.lit, reference))
    total = F.aggregate(F.zip_with(shares, known, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / 2)


def references(counted: DataFrame, languages: Sequence[str]) -> dict[str | None, tuple[list[float], list[float]]]:
    """The shares of classes and common words of each listed language, and of all of them under None."""
    bins = [c for c in counted.columns if c[0] in "cw" and c[1:].isdigit()]
    sums = (
        counted.where(~F.col("base_failed") & F.col("lang").isin(list(languages)))
        .groupBy("lang")
        .agg(*(F.sum(c).alias(c) for c in [*bins, "chars", "letter_words"]))
        .collect()  # a row a listed language
    )

    def shares(rows) -> tuple[list[float], list[float]]:
        out = []
        for letter, total in (("c", "chars"), ("w", "letter_words")):
            counts = [sum(r[b] for r in rows) for b in bins if b[0] == letter]
            whole = max(sum(r[total] for r in rows), 1)
            out.append([n / whole for n in [*counts, whole - sum(counts)]])
        return out[0], out[1]

    found: dict[str | None, tuple[list[float], list[float]]] = {r["lang"]: shares([r]) for r in sums}
    return found | ({None: shares(sums)} if sums else {})


def judge(
    documents: DataFrame, languages: Sequence[str] = tuple(COMMON_WORDS), max_class: float = 0.25, max_words: float = 0.42,
    min_chars: int = 100, min_words: int = 30,
) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, class_distance, word_distance) of every document.

    A distance is NULL where there is too little to compare, and does not count against the document then.
    """
    counted = materialize(base_counts(documents, "lang"), "histograms")
    known = references(counted, languages)
    classes = [F.col(c) for c in counted.columns if c[0] == "c" and c[1:].isdigit()]
    common = [F.col(c) for c in counted.columns if c[0] == "w" and c[1:].isdigit()]

    def nearest(shares: Column, which: int, enough: Column) -> Column:
        found = F.lit(None).cast("double")
        if known:
            found = distance(shares, known[None][which])
            for language in sorted(x for x in known if x is not None):
                found = F.when(F.col("lang") == language, distance(shares, known[language][which])).otherwise(found)
        return F.when(enough, found)

    measured = counted.select(
        "*",
        nearest(_shares(classes, F.col("chars")), 0, F.col("chars") >= min_chars).alias("class_distance"),
        nearest(_shares(common, F.col("letter_words")), 1, F.col("letter_words") >= min_words).alias("word_distance"),
    )
    strange = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("word_distance") > max_words, F.lit(False))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~strange).alias("kept"), "class_distance", "word_distance",
    )
