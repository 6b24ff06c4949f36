"""Quality rules at host level, with DataFrame functions only.

Per document: counts over its words and lines. Per host: how many of its documents break
each rule, as a rate shrunk towards all hosts by a beta prior that is fitted to the hosts'
rates (method of moments). A host whose shrunk rate passes a limit is bad; the verdict is
joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.common import keep, maybe_broadcast

WORD_GAP = "[ \\t-\\r]+"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; each share is in percent of the document's words or lines."""

    least_words: int = 10
    most_repeat: int = 20
    most_symbols: int = 10
    most_dup_lines: int = 30
    least_mean_chars: int = 2
    most_mean_chars: int = 15
    #: a host is bad when the shrunk rate of one rule is above this
    most_host_rate: float = 0.6
    #: strength of the prior where the hosts' rates do not differ
    most_strength: float = 1000.0


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""
    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])

    def covered(found: Column) -> Column:
        def marks(s: Column) -> Column:
            last = F.size(s) - 1
            return F.filter(s, lambda x, k: (
                ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))))

        places = F.array_sort(F.transform(
            bind(F.array_sort(F.transform(found, lambda h, i: F.struct(
                h.alias("h"), i.alias("i")))), marks), lambda x: x["i"]))
        return bind(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(
                F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x))

    return bind(words, lambda w: F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(
        bind(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: window(w, i)),
             lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0))
             .otherwise(covered(found)))))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source") -> DataFrame:
    """(id_col, host_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines).

    A null text has no words and no lines.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(F.col(id_col), F.col(host_col), text.alias("__text"))
        .select(
            id_col, host_col,
            bind(word_list(F.col("__text")), lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).cast("long").alias("n_repeat_words"))).alias("__w"),
            F.length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).cast("long")
            .alias("n_symbols"),
            bind(F.filter(F.split("__text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")),
                 lambda a: F.struct(
                     F.size(a).cast("long").alias("n_lines"),
                     (F.size(a) - F.size(F.array_distinct(a))).cast("long")
                     .alias("n_dup_lines"))).alias("__l"))
        .select(id_col, host_col, "__w.n_words", "__w.word_chars", "n_symbols",
                "__l.n_dup_lines", "__w.n_repeat_words", "__l.n_lines"))


def rule_failures(rules: Rules) -> dict[str, Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "fail_short": words < rules.least_words,
        "fail_repeat": 100 * F.col("n_repeat_words") > rules.most_repeat * words,
        "fail_symbols": 100 * F.col("n_symbols") > rules.most_symbols * chars,
        "fail_dup_lines": 100 * F.col("n_dup_lines") > rules.most_dup_lines * F.col("n_lines"),
        "fail_word_length": (chars < rules.least_mean_chars * words)
        | (chars > rules.most_mean_chars * words),
    }


def host_verdicts(measured: DataFrame, rules: Rules, host_col: str = "source") -> DataFrame:
    """(host_col, host_docs, host_rate, host_bad): one row per host; a null host is one.

    The prior of a rule has the mean m and variance v of the hosts' rates (each host counts
    once): strength = m (1 - m) / v - 1, within 0 and ``most_strength``. A host's rate is
    (failures + strength * m) / (documents + strength); ``host_rate`` is the largest.
    """
    names = list(rule_failures(rules))
    hosts = measured.groupBy(host_col).agg(
        F.count("*").alias("host_docs"), *[F.sum(F.col(n).cast("long")).alias(n) for n in names])
    rates = [(F.col(n) / F.col("host_docs")) for n in names]
    moments = hosts.agg(*[x for n, r in zip(names, rates) for x in (
        F.avg(r).alias(f"m_{n}"), F.var_pop(r).alias(f"v_{n}"))]).first()  # one row
    shrunk = []
    for n in names:
        m, v = moments[f"m_{n}"] or 0.0, moments[f"v_{n}"] or 0.0
        strength = rules.most_strength
        if v > 0:
            strength = max(0.0, min(strength, m * (1 - m) / v - 1))
        shrunk.append((F.col(n) + F.lit(strength * m)) / (F.col("host_docs") + F.lit(strength)))
    return (hosts.withColumn("host_rate", F.greatest(*shrunk))
            .withColumn("host_bad", F.col("host_rate") > rules.most_host_rate)
            .select(host_col, "host_docs", "host_rate", "host_bad"))


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id",
          text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures, ``base_failed``, the host's rate and ``kept`` of every row.

    Documents that fail the base limits (too few words, too many repeated windows) go, and
    all documents of a bad host. A null host is a host of its own, an empty table gives no
    rows, repeated rows are judged alike, other columns are not read. The measures (a few
    numbers a document) are written once to the shared folder, as they are read twice.
    """
    slim = measures(docs.select(F.col(id_col), F.col(text_col), F.col(host_col)),
                    id_col, text_col, host_col)
    for name, failed in rule_failures(rules).items():
        slim = slim.withColumn(name, failed)
    slim = keep(slim, "host-rules")
    hosts = keep(host_verdicts(slim, rules, host_col), "hosts")
    small = maybe_broadcast(hosts.withColumnRenamed(host_col, "__host"), hosts.count())
    return (
        slim.join(small, F.col(host_col).eqNullSafe(F.col("__host")), "left").drop("__host")
        .withColumn("base_failed", F.col("fail_short") | F.col("fail_repeat"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad")))
