"""Quality rules with verdicts on whole hosts, with DataFrame functions only.

Method: each document is measured in one pass and tried against the rules. Rule failures are summed per host (`source`),
the rates are shrunk toward the corpus by a beta prior fitted to the hosts (method of moments), and the host verdicts are
joined back: a document of a host with a high shrunk rate needs to pass every rule, one of an ordinary host may fail one
minor rule. So a good document stays, whatever its host.

Hosts are summed with partial aggregates and the prior comes from sums over hosts, so a host with a third of all rows is no
large group; the join back carries a few numbers per document and deals a large host out by row.

Defined cases: a null or empty text has no words and fails. A null host is a host of its own. Repeated rows count as often
as they stand. `filter_documents` keeps every column of the rows it keeps. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skirmish.llm.common import join_dealt, materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Limits of the minor rules.
MAX_SYMBOLS_PER_WORD, MAX_DUPLICATE_LINES, WORD_CHARS = 0.1, 0.3, (2.0, 20.0)
#: Shrunk share of failing documents from which a host counts as poor.
POOR_HOST = 0.5

MINOR = ("symbols", "lines", "word_length")


def measures(text: Column) -> dict[str, Column]:
    """Columns to add one after the other: each may use the ones before (names with a leading underscore are steps)."""
    t = F.coalesce(text, F.lit(""))
    words, windows = F.col("_words"), F.col("_windows")
    word_lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "_words": F.filter(F.split(t, SPACE, -1), lambda w: w != ""),
        "_lines": word_lines,
        "n_lines": F.size("_lines").cast("long"),
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size(words) >= 3, F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.concat_ws(
            " ", w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<string>")),
        "n_repeat_words": F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_covered(windows)).cast("long"),
    }


def _covered(windows: Column) -> Column:
    """Words in three-word windows that occur twice or more: the windows sorted, those equal to a neighbour kept, their
    places sorted, and each adding the words that the one before has not covered."""
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def places(s: Column) -> Column:
        at = lambda i: F.get(s, i)["w"]
        twice = F.filter(F.transform(s, lambda x, i: F.when(x["w"].eqNullSafe(at(i - 1)) | x["w"].eqNullSafe(at(i + 1)), x["i"])), lambda i: i.isNotNull())
        return F.array_sort(twice)

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), x - F.get(p, i - 1)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    bind = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    return bind(placed, lambda s: bind(places(s), total))


def measured(docs: DataFrame, keys: dict[str, Column], text: Column) -> DataFrame:
    """The keys and the measures of each row."""
    df = docs.select(*(c.alias(k) for k, c in keys.items()), text.alias("_text"))
    for name, column in measures(F.col("_text")).items():
        df = df.withColumn(name, column)
    return df.drop("_text", "_words", "_lines", "_windows")


def failures(df: DataFrame) -> DataFrame:
    """base_failed and one flag for each minor rule."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "base_failed": base, "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"),
        "lines": F.col("n_dup_lines") > MAX_DUPLICATE_LINES * F.col("n_lines"), "word_length": ~length.between(*WORD_CHARS)})


def host_rates(df: DataFrame, host: str = "host") -> DataFrame:
    """(host, n, failed, rate): the rate is the mean of the beta posterior, whose prior fits the hosts' own rates.

    A host's failures are binomial in its rate; mean and variance over hosts (weighted by documents) give the prior, and
    where the hosts vary no more than chance the prior is as strong as the corpus.
    """
    failing = F.col("base_failed") | F.col("symbols") | F.col("lines") | F.col("word_length")
    hosts = df.groupBy(host).agg(F.count("*").alias("n"), F.sum(failing.cast("long")).alias("failed"))
    sums = hosts.agg(F.sum("n").alias("sn"), F.sum("failed").alias("sf"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("sn2"),
                     F.sum(F.try_divide(F.col("failed") * F.col("failed"), F.col("n"))).alias("sq"))
    mean = F.try_divide(F.col("sf"), F.col("sn"))
    within = mean * (1 - mean)
    spread = F.try_divide(F.col("sq") - F.col("sn") * mean * mean - (F.col("k") - 1) * within, F.col("sn") - F.try_divide(F.col("sn2"), F.col("sn")))
    strength = F.coalesce(F.when(spread > 0, F.greatest(F.lit(1.0), F.try_divide(within, spread) - 1)), F.col("sn").cast("double"))
    prior = sums.select(F.coalesce(mean, F.lit(0.0)), F.coalesce(strength, F.lit(1.0))).first()
    return hosts.select(host, "n", "failed", ((F.col("failed") + prior[0] * prior[1]) / (F.col("n") + prior[1])).alias("rate"))


def _with_hosts(rows: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """The rows with their host's rate; a host with many rows is dealt out."""
    stored = materialize(hosts, "hosts")
    return join_dealt(rows, stored.select(host, F.col("rate").alias("host_rate")), [host], stored.select(host, "n"))


def _kept() -> Column:
    minor = sum((F.col(c).cast("int") for c in MINOR), F.lit(0))
    # one expression over both sides of the join: the optimizer must not copy the measures into a filter below it
    return F.when(F.col("base_failed"), False).otherwise(minor <= F.when(F.col("host_rate") >= POOR_HOST, 0).otherwise(1))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate) of each row."""
    stored = materialize(failures(measured(docs, {"doc_id": F.col(key), "host": F.col(host)}, F.col(text))), "quality-measures")
    judged = _with_hosts(stored, host_rates(stored), "host").withColumn("kept", _kept())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that the rules keep, with their own columns. Texts are measured again rather than stored or shuffled."""
    rows = failures(measured(docs, {"doc": F.struct(*(F.col(f"`{c}`") for c in docs.columns)), "host": F.col(host)}, F.col(text)))
    rates = host_rates(materialize(rows.drop("doc"), "quality-measures"))
    return _with_hosts(rows, rates, "host").filter(_kept()).select("doc.*")
