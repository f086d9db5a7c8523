"""URL filters: listed rules first, else naive Bayes over the words of host and path.

Names like ``cheappills`` are split into words by a unigram model: of all splits the one whose words have the greatest
product of probabilities, found by dynamic programming over the name's positions (Viterbi). The unigram counts cover
the visible words of all pages and stay in a table; a name is joined with those of its own pieces that are words, so a
task holds one name's words at a time and nothing of the vocabulary goes through the driver. A piece of n letters that is no word may
stand as it is, at the price of one unseen word and of a tenth for each letter; words have two letters at least. Runs of digits
are one token.

Naive Bayes learns from the pages: a page that a rule fits is an example of what the rule says, any other page of what its
content says, which is to block if its visible text has a word of ``seeds`` or many marks. The URL's own words decide
nothing but the score. The token counts stay in a table too; each different name is scored once.

Defined results: a NULL URL and one without ``://`` have an empty host and path, fit no rule and have no words: they get
the more frequent class. A page without ``html`` is an example only where a rule fits. Repeated rows count one by one. Equal scores allow.
Without pages the result is empty. Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import inf, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.scratch import materialize

#: words that mark a page as an example to block
SEEDS = frozenset(
    "ads adult bet bets betting bitcoin bonus casino cheap cialis crypto escort gambling jackpot loan loans lottery malware"
    " nude payday phishing pill pills poker porn replica scam sex slots spam spammer torrent tracker track viagra warez xxx".split()
)
NUMBER = "<number>"
#: share of marks in the visible text from which a page is an example to block
MARKS, MARK_SHARE = r"[#*$%&|<>]", 0.02
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where there is no ``://``."""
    begin = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as (rule, action), or NULL. Rules are (host, path, action)."""
    found = F.lit(None)
    for rule_host, rule_path, action in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def visible(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, uses): the lower-case Latin words of two letters or more in the visible text of all pages."""
    found = pages.select(F.explode(F.split(F.lower(visible(F.col("html"))), r"[^a-z]+")).alias("word")).where("length(word) > 1")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))


def split(name: str, uses: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a run of letters; of equal ones that with the longer first words."""
    unseen, letter, longest = log(total + 1), log(10), max(map(len, uses), default=0)
    size = len(name)
    cost, end_of = [0.0] * (size + 1), [size] * (size + 1)
    run, run_end = inf, size  # an unseen piece from here on: its letters and what follows it
    for begin in range(size - 1, -1, -1):
        if cost[begin + 1] < run - 1e-12:
            run, run_end = cost[begin + 1], begin + 1
        run += letter
        found, end = unseen + run, run_end
        for to in range(min(begin + longest, size), begin, -1):
            seen = uses.get(name[begin:to])
            if seen and unseen - log(seen) + cost[to] < found - 1e-12:
                found, end = unseen - log(seen) + cost[to], to
        cost[begin], end_of[begin] = found, end
    words, at = [], 0
    while at < size:
        words.append(name[at : end_of[at]])
        at = end_of[at]
    return words


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, tokens) of different names, by the ``counts`` of words."""
    total = counts.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    # the lengths that words have: a few dozen numbers
    lengths = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect())
    size = F.length("name")
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= size)
    pieces = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substring("name", at, n))))
    asked = names.where("name rlike '^[a-z]'").select("name", F.explode(F.array_distinct(pieces)).alias("word"))
    # of each piece that is a word, with its uses; no more than the name has pieces
    met = asked.join(counts, "word").groupBy("name").agg(F.collect_list("word").alias("words"), F.collect_list("uses").alias("uses"))

    @F.pandas_udf("array<string>")
    def tokens(name: pd.Series, words: pd.Series, uses: pd.Series) -> pd.Series:
        known = [dict(zip(w, u, strict=True)) if w is not None else {} for w, u in zip(words, uses, strict=True)]
        return pd.Series([[NUMBER] if n[:1].isdigit() else split(n, k, total) for n, k in zip(name, known, strict=True)], dtype=object)

    return names.join(met, "name", "left").select("name", tokens("name", "words", "uses").alias("tokens"))


def judge(pages: DataFrame, rules: Sequence[Rule], seeds: frozenset[str] = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score) of every page; ``words`` are the tokens, joined by blanks."""
    host, path = parts(F.col("url"))
    text = visible(F.col("html"))
    marked = F.regexp_count(text, F.lit(MARKS)) >= MARK_SHARE * F.length(text)
    seeded = F.lower(text).rlike(rf"(?<![a-z])({'|'.join(sorted(seeds))})(?![a-z])") if seeds else F.lit(False)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(
        "page_id", "host", "path", fit.alias("fit"),
        F.when(fit.isNotNull(), fit["action"] == "block").when(F.col("html").isNotNull() & (F.length(text) > 0), marked | seeded).alias("bad"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "pages")
    runs = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    uses = materialize(rows.select("row", "bad", F.posexplode(runs).alias("pos", "name")), "names")
    names = uses.groupBy("name").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    names = materialize(names, "different")
    splits = materialize(split_names(names, materialize(word_counts(pages), "words")), "splits")
    parted = splits.select("name", F.explode("tokens").alias("token"))
    tokens = parted.join(names, "name").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tokens = materialize(tokens, "tokens")
    sums = tokens.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))).first()
    bad, good = rows.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    total = [n + sums[2] for n in sums[:2]]
    lean = F.log((F.col("bad") + 1) / F.lit(max(total[0], 1))) - F.log((F.col("good") + 1) / F.lit(max(total[1], 1)))
    of_name = parted.join(tokens.select("token", lean.alias("lean")), "token").groupBy("name").agg(F.sum("lean").alias("lean"))
    known = splits.join(of_name, "name")
    told = uses.select("row", "pos", "name").join(known, "name").groupBy("row").agg(
        F.sum("lean").alias("lean"), F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("parts"))
    score = F.lit(log((bad + 1) / (good + 1))) + F.coalesce("lean", F.lit(0.0))
    return rows.join(told, "row", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.action", F.when(score > 1e-9, "block").otherwise("allow")).alias("verdict"),
        F.coalesce(F.array_join(F.flatten("parts.tokens"), " "), F.lit("")).alias("words"),
        score.alias("score"),
    )
