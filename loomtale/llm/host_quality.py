"""Host-level quality rules, in DataFrame functions only.

Each document gets counts by the base rules.  Failures are summed by host (the
source column); over all hosts a beta prior is fitted by the method of moments;
each host's failure rate is shrunk towards it; and the verdict is joined back: a
host is rejected if even the lower end of its shrunk rate says that most of its
documents fail.  A document stays if its own rules pass and its host isn't rejected.

Null text has no words, so it fails (too few words).  A null host is a host of its
own.  Repeated rows count as often as they occur.  Very long texts stay in one row:
arrays of their words, no explosion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A document fails with fewer words, or with more of its words (in per cent) inside repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A host is rejected if its shrunk rate less Z standard deviations is above this share.
HOST_LIMIT, Z = 0.5, 2.0
#: Hosts whose verdicts are broadcast, at about 50 bytes each.
MOST_BROADCAST = 500_000
#: Documents that the prior weighs at least and at most.
PRIOR_LEAST, PRIOR_MOST = 2.0, 1000.0

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"


def _let(value: Column, f) -> Column:
    """f(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def _windows(words: Column, hashed: bool = False) -> Column:
    """Every run of WINDOW words, joined by a space, which no word holds, or its hash."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    of = F.xxhash64 if hashed else lambda *w: F.concat_ws(" ", *w)
    return F.transform(starts, lambda i: of(*[F.get(words, i + k) for k in range(WINDOW)]))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more."""

    def places(order: Column) -> Column:
        # sorted by window: a window is repeated if a neighbour is equal
        at = lambda i: F.get(order, i)["w"]
        twice = F.filter(
            F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.when(F.coalesce(at(i) == at(i + 1), F.lit(False)) | F.coalesce(at(i) == at(i - 1), F.lit(False)), F.get(order, i)["i"])),
            lambda p: p.isNotNull(),
        )
        return F.array_sort(twice)

    def width(found: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.least(F.lit(WINDOW), F.coalesce(F.get(found, i + 1) - F.get(found, i), F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    order = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return _let(order, lambda o: _let(places(o), width))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(docs: DataFrame) -> DataFrame:
    """``docs``, which has a column text, with MEASURES and base_failed."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = words_of(F.col("text"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def repeats(w: Column) -> Column:
        # where all hashes differ all windows do; elsewhere the windows themselves are compared
        repeated = F.size(F.array_distinct(_windows(w, hashed=True))) < F.size(w) - WINDOW + 1
        return F.when(F.size(w) <= WINDOW, F.lit(0)).when(repeated, _covered(_windows(w))).otherwise(F.lit(0))

    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.octet_length(t) - F.octet_length(F.regexp_replace(t, SYMBOLS, ""))
    counted = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeats(w).cast("long").alias("n_repeat_words"),
        ),
    )
    # a generator keeps the optimizer from writing the expression out once for each field
    out = docs.select("*", F.explode(F.array(counted)).alias("counted"))
    out = out.select(*docs.columns, *[F.col(f"counted.{n}").alias(n) for n in MEASURES])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    inner = common.Inner(docs, (*MEASURES, "base_failed"), text=text)
    return inner.outer(_measure(inner.df), *MEASURES, "base_failed")


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """A row for each host: host, n_docs, n_failed, host_rate (shrunk), host_rejected.

    The prior's mean is the share of failures over all hosts, its weight comes from how far the
    hosts' rates differ beyond chance, each host weighing by its documents.
    """
    hosts = measured.groupBy(F.col(f"`{host.replace('`', '``')}`").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    n, x = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    prior = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(n * n).alias("nn"), F.sum(x * x / n).alias("xx"), F.count(F.lit(1)).alias("k"))
    mean = F.col("x") / F.col("n")
    # the weighted variance of the hosts' rates is p(1-p) * ((k-1)/n + (1 - nn/n^2) * rho), with rho = 1/(weight+1)
    between = F.col("xx") / F.col("n") - mean * mean
    chance = mean * (1 - mean)
    rho = (between / F.nullif(chance, F.lit(0.0)) - (F.col("k") - 1) / F.col("n")) / F.nullif(1 - F.col("nn") / (F.col("n") * F.col("n")), F.lit(0.0))
    weight = F.coalesce(F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(PRIOR_MOST), 1 / F.nullif(F.greatest(rho, F.lit(1e-9)), F.lit(0.0)) - 1)), F.lit(PRIOR_LEAST))
    prior = prior.select(mean.alias("mean"), weight.alias("weight"))
    a = F.col("n_failed") + F.col("mean") * F.col("weight")
    total = F.col("n_docs") + F.col("weight")
    rate = a / total
    low = rate - Z * F.sqrt(rate * (1 - rate) / (total + 1))
    # the prior is one row: an aggregate without keys, broadcast to the hosts
    joined = hosts.join(F.broadcast(prior), on=F.lit(True))
    return joined.select("host", "n_docs", "n_failed", rate.alias("host_rate"), F.coalesce(low > HOST_LIMIT, F.lit(False)).alias("host_rejected"))


def judge(docs: DataFrame, *, text: str = "text", host: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures, host_rate and ``kept``; without ``keep_text`` the text is null.

    The measures are written once, so that texts are read and matched once; hosts are aggregated
    from them with partial sums, so that a hot host costs no more than another.  Verdicts are
    broadcast while there are at most ``MOST_BROADCAST`` hosts; beyond, Spark shuffles both sides and
    splits a hot host.
    """
    inner = common.Inner(docs, (*MEASURES, "base_failed", "host_rate", "kept"), text=text, source=host)
    measured = _measure(inner.df)
    if not keep_text:
        measured = measured.withColumn("text", F.lit(None).cast("string"))
    stage = common.Staged(measured, "measures")
    verdicts = common.Staged(host_verdicts(stage.df).select("host", "host_rate", "host_rejected"), "hosts").df
    few = verdicts.count() <= MOST_BROADCAST
    out = stage.df.join(F.broadcast(verdicts) if few else verdicts, F.col("source").eqNullSafe(F.col("host")), "left")
    return inner.outer(out, *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))
