"""URL filters: rules first, then naive Bayes over the words of host and path.

Host names often run words together. The distinct host labels are cut into words
by Viterbi over unigram counts of the words in paths and page titles: Spark joins
every substring of a label to its count, so the dictionary is never in one place.
A multinomial naive Bayes model over hashed tokens, learned from the pages that
rules decide, judges the others; its size is fixed by ``BUCKETS``.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reconcile.llm.storage import salted_lookup

#: (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Hash buckets of tokens; longest word that can be cut from a label.
BUCKETS, LONGEST = 1 << 16, 20
#: Pieces of labels that a task gives out at once.
PIECES = 50_000


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """After the first ``://``: lower-case host, then path up to query or fragment; both empty without it."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule fits its host and all hosts below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w != "")


def unigrams(pages: DataFrame) -> DataFrame:
    """word, n over the paths and titles of all pages (url, html)."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    _, path = host_and_path(F.col("url"))
    words = pages.select(F.explode(F.concat(_words(path), _words(F.coalesce(title, F.lit(""))))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _pieces(longest: int):
    """key, label -> key, start, stop, word: every piece of a label of at most ``longest`` characters, some thousand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "start", "stop", "word"])

        for batch in batches:
            rows: list[tuple] = []
            for key, label in zip(*(column.to_pylist() for column in batch.columns)):
                for start in range(len(label)):
                    rows += [(key, start, stop, label[start:stop]) for stop in range(start + 1, min(start + longest, len(label)) + 1)]
                    if len(rows) > PIECES:
                        yield given(rows)
                        rows = []
            if rows:
                yield given(rows)

    return run


def _viterbi(all_words: int, longest: int):
    def cut(label: str, known) -> list[str]:
        score = {(piece["start"], piece["stop"]): np.log(piece["n"] / all_words) for piece in known}
        unknown = [np.log(10.0 / all_words) - np.log(10.0) * size for size in range(longest + 1)]
        best, back = [0.0], [0]
        for stop in range(1, len(label) + 1):
            # Of equal cuts the one with the longest last word.
            found = ((best[start] + score.get((start, stop), unknown[stop - start]), -start) for start in range(max(0, stop - longest), stop))
            most, start = max(found)
            best.append(most)
            back.append(-start)
        words, stop = [], len(label)
        while stop:
            words.append(label[back[stop] : stop])
            stop = back[stop]
        return words[::-1]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(labels: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([cut(label, () if pieces is None else pieces) for label, pieces in zip(labels, known)])

    return run


def segment(labels: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """label, words of the distinct non-empty labels, from unigram counts (word, n).

    The word with n of N counts scores ln(n / N); an unknown one of c characters
    ln(10 / (N 10^c)), so that known words win. Words have ``longest`` characters at most.
    What is gathered for a label is its known pieces, so a label may be very long.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).withColumn("all", F.greatest("all", F.lit(1)))
    (all_words,) = total.first()  # one number
    named = labels.select(F.sha2("label", 256).alias("key"), "label")
    pieces = named.mapInArrow(_pieces(longest), "key string, start int, stop int, word string")
    known = pieces.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("start", "stop", "n")).alias("known"))
    return named.join(known, "key", "left").select("label", _viterbi(all_words, longest)("label", "known").alias("words"))


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words of the distinct hosts: its labels in order, each cut into words; no row for a host of dots and marks only."""
    labels = hosts.select("host", F.posexplode(F.split("host", "[.]")).alias("at", "label"))
    parts = labels.select("host", "at", F.posexplode(F.split("label", "[-_]+")).alias("part", "label")).where("label <> ''")
    cut = segment(parts.select("label").distinct(), counts)
    words = parts.join(cut, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "part", "words"))).alias("all"))
    return words.select("host", F.flatten(F.transform("all", lambda p: p["words"])).alias("words"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and words of every row of pages (page_id, url, html).

    The verdict is the longest fitting rule's, else naive Bayes'; ``score`` is
    its log odds for blocking, and 0 (allow) if no page decided by a rule is
    known on either side. A null url, or one without ``://``, has an empty host and
    path; an empty host, or one of dots and marks only, has no words. Repeated rows are judged each; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("by_rule", verdict)
    words = host_words(parsed.select("host").where("host <> ''").distinct(), unigrams(pages))
    none = F.array().cast("array<string>")
    blank = parsed.where("host = ''").withColumn("words", none)
    named = salted_lookup(parsed.where("host <> ''"), words, "host", F.col("page_id"), how="left")
    named = named.withColumn("words", F.coalesce("words", none))
    in_path = F.filter(F.split(F.lower(F.regexp_replace("path", "[0-9]+", "0")), "[^\\p{L}0-9]+"), lambda w: w != "")
    tokens = F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), F.transform(in_path, lambda w: F.concat(F.lit("p:"), w)))
    named = named.unionByName(blank).withColumn("buckets", F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")))

    taught = named.where("rule IS NOT NULL")
    counts = taught.select("by_rule", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count_if(F.col("by_rule") == "block").alias("block"), F.count_if(F.col("by_rule") == "allow").alias("allow")
    ).collect()  # at most BUCKETS rows
    priors = {row["by_rule"]: row["count"] for row in taught.groupBy("by_rule").count().collect()}  # two rows
    odds, prior = np.zeros(BUCKETS), 0.0
    if len(priors) == 2:
        seen = np.ones((2, BUCKETS))
        for bucket, block, allow in counts:
            seen[:, bucket] += block, allow
        odds = np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum())
        prior = float(np.log(priors["block"] / priors["allow"]))

    @F.pandas_udf("double")
    def log_odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for buckets in batches:
            yield buckets.map(lambda b: prior + float(odds[b].sum()) if len(b) else prior)

    scored = named.withColumn("score", log_odds("buckets"))
    said = F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", said.alias("verdict"), "score", "words")
