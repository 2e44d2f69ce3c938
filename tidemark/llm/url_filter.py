"""URL filter: list rules, then the log-likelihood ratio of two character language models.

Rules decide the URLs that they fit. The URLs that rules allow and those that rules block train two variable-order Markov
models over bytes: the chance of a byte after the k bytes before it is smoothed with its chance after k - 1, down to a uniform
one. A model is a table with a row for each distinct run of ORDER + 1 bytes, counted over every ruled URL, so it grows with
the input; the counts of shorter contexts are sums over it. The score of a URL is the
difference of the two log-likelihoods, divided by its length. A logistic calibration turns it into a chance, which gives the
verdict where no rule does. For the calibration the ruled URLs are cut into two halves, each scored by what the other one
counted; all of them count for the URLs to be judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, small_batches
from .toxicity import logistic

#: Rules (host/path, verdict): a rule fits its host and all subdomains, if the path starts with its path. The longest wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Bytes of the longest context: with the byte itself, a run that fits a long.
ORDER = 5
#: Weight of the shorter context's chance, in bytes seen.
PRIOR = 2.0
#: Bins of ratios from -8 to 8 that the calibration is fitted on.
_BINS = 512


def host_of(url: str | Column) -> Column:
    """The host: after the first ://, up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """The path: after the host, up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def runs_of(urls: list[str]) -> pa.ListArray:
    """For each byte of each URL: it and the ORDER bytes before it (zeros before the start), the byte itself lowest."""
    raw = [u.encode() for u in urls]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(bytes(ORDER) + x for x in raw), np.uint8).astype(np.int64)
    at = np.arange(sizes.sum()) + np.repeat(ORDER * np.arange(1, len(raw) + 1), sizes)
    runs = np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        runs |= data[at - k] << 8 * k
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(runs))


def _with_runs(urls: DataFrame) -> DataFrame:
    """urls(..., url) with `run`, a row for each byte, instead of url; empty URLs have none."""
    fields = urls.schema.fields[:-1]

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], runs_of(batch.column(batch.num_columns - 1).to_pylist())], names=[*batch.schema.names[:-1], "runs"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "runs array<bigint>"])
    return urls.mapInArrow(cut, schema).select(*(f.name for f in fields), F.explode("runs").alias("run"))


#: The models: of all ruled URLs, and of those that aren't in the first or the second half. Each has counts by class.
_MODELS = ("all", "not_0", "not_1")
_COUNTS = [f"{m}_{c}" for m in _MODELS for c in ("allow", "block")]


def run_counts(urls: DataFrame) -> DataFrame:
    """run, uses (how many bytes of all URLs have it) and its counts by model and class, of urls(url, allowed, half, n)."""
    rows = _with_runs(urls.select("allowed", "half", "n", "url"))
    found = rows.groupBy("run").agg(
        F.count("*").alias("uses"),
        *(F.sum(F.when((F.col("allowed") == (c == "allow")) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"h{h}_{c}") for h in (0, 1) for c in ("allow", "block")),
    )
    of = {"all": lambda c: F.col(f"h0_{c}") + F.col(f"h1_{c}"), "not_0": lambda c: F.col(f"h1_{c}"), "not_1": lambda c: F.col(f"h0_{c}")}
    return found.select("run", "uses", *(of[m](c).alias(f"{m}_{c}") for m in _MODELS for c in ("allow", "block")))


def _short_chances(pairs: pa.Table) -> pa.Table:
    """Chances of a byte after the one before it, of counts by pair of bytes: at most 65,536 rows, worked out on the driver."""
    at = np.asarray(pairs["pair"])
    out = {"pair": pairs["pair"]}
    for c in _COUNTS:
        n = np.zeros(1 << 16)
        n[at] = np.asarray(pairs[c], float)
        after = n.reshape(256, 256)  # the byte before, the byte
        p = (after.sum(axis=0) + PRIOR / 256) / (n.sum() + PRIOR)
        p = (after + PRIOR * p[None, :]) / (after.sum(axis=1, keepdims=True) + PRIOR)
        out[f"p_{c}"] = pa.array(p.ravel()[at])
    return pa.table(out)


def run_ratios(counts: DataFrame) -> DataFrame:
    """run, uses, and by model the difference of the logarithms of the last byte's chances, of run_counts().

    Contexts of up to one byte have at most 65,536 counts, which are broadcast. Runs are then dealt by the two bytes before
    the last one: all runs that share a longer context, or a longer end, are in one partition, so these counts are sums over
    windows, spilled if need be, without another exchange.
    """

    def last(n: int, c="run") -> Column:
        return F.col(c).bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))

    pairs = counts.groupBy(last(2).alias("pair")).agg(*(F.sum(c).alias(c) for c in _COUNTS)).toArrow()
    first = counts.sparkSession.createDataFrame(_short_chances(pairs)) if len(pairs) else None
    if first is None:
        return counts.select("run", "uses", *(F.lit(0.0).alias(m) for m in _MODELS))
    rows = counts.withColumn("before", F.shiftright("run", 8)).withColumn("near", last(2, "before")).repartition("near")
    rows = rows.withColumn("pair", last(2)).join(F.broadcast(first), "pair")
    for k in range(2, ORDER + 1):
        rows = rows.withColumn("end", last(k + 1)).withColumn("context", last(k, "before"))
        seen, of = Window.partitionBy("near", "end"), Window.partitionBy("near", "context")
        n = {c: F.sum(c).over(seen) if k < ORDER else F.col(c) for c in _COUNTS}
        rows = rows.withColumns({f"n_{c}": n[c] for c in _COUNTS}).withColumns({f"of_{c}": F.sum(c).over(of) for c in _COUNTS})
        rows = rows.withColumns({f"p_{c}": (F.col(f"n_{c}") + PRIOR * F.col(f"p_{c}")) / (F.col(f"of_{c}") + PRIOR) for c in _COUNTS})
    return rows.select("run", "uses", *((F.log(f"p_{m}_allow") - F.log(f"p_{m}_block")).alias(m) for m in _MODELS))


def url_ratios(urls: DataFrame) -> DataFrame:
    """urls(url, allowed, half, n) with `ratio`: the length-normalised log-likelihood difference, allowed less blocked.

    url: distinct texts; allowed: what a rule says, or null; half: 0 or 1; n: how often the URL is there. Ruled URLs get the
    ratio of the models that their own half isn't in. Empty URLs get zero.
    """
    urls = checkpoint(urls.withColumn("id", F.monotonically_increasing_id()))
    ratios = checkpoint(run_ratios(checkpoint(run_counts(urls))))
    which = F.when(F.col("allowed").isNull(), "all").otherwise(F.concat(F.lit("not_"), F.col("half")))
    rows = _with_runs(urls.select("id", which.alias("which"), "url"))
    value = F.coalesce(*(F.when(F.col("which") == m, F.col(m)) for m in _MODELS))
    sums = join_hot(rows, ratios, "run", "uses").groupBy("id").agg((F.sum(value) / F.count("*")).alias("ratio"))
    return urls.join(sums, "id", "left").select("url", "allowed", "half", "n", F.round(F.coalesce("ratio", F.lit(0.0)), 9).alias("ratio"))


def calibration(ratios: DataFrame) -> tuple[float, float]:
    """Bias and slope of the chance of being acceptable, by the ruled URLs of url_ratios().

    They are fitted on a histogram of fixed size: every ruled URL counts, and the driver gets a bounded table.
    """
    cell = F.floor(F.greatest(F.lit(-8.0), F.least(F.lit(7.99), "ratio")) * (_BINS / 16)).alias("bin")
    bins = ratios.filter("allowed is not null").groupBy("allowed", cell).agg(F.sum("n").alias("n")).orderBy("allowed", "bin").collect()
    if len({r.allowed for r in bins}) < 2:
        return 0.0, 1.0
    x = np.array([(r.bin + 0.5) * 16 / _BINS for r in bins])[:, None]
    return _weighted_logistic(x, np.array([float(r.allowed) for r in bins]), np.array([r.n for r in bins], float))


def _weighted_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Platt's logistic fit of binned ratios, each class weighing the same, so that the threshold doesn't follow the rules' mix."""
    for c in (0.0, 1.0):
        w = np.where(y == c, w / w[y == c].sum(), w)
    scaled = np.maximum(1, np.round(w * 2000)).astype(int)
    bias, slope = logistic(np.repeat(x, scaled, axis=0), np.repeat(y, scaled))
    return float(bias), float(slope)


def judged(pages: DataFrame, rules=RULES, page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, chance) of every row: chance is the models' chance that the URL is acceptable.

    Null URLs and URLs without :// have an empty host and path and fit no rule; the models still judge what there is (an
    empty URL by the calibration's bias). Very long URLs count whole. Repeated rows repeat and count in training each time; an
    empty table gives an empty one. If rules label no URL of one class, the ratio alone decides, and no ratio allows. Other
    columns are left out. The chance of a ruled URL is by the models that its own half isn't in.
    """
    small_batches(pages.sparkSession)
    urls = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    urls = urls.withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    distinct = urls.groupBy("url").agg(F.max(verdict_of(F.col("rule"), rules) == "allow").alias("allowed"), F.count("*").alias("n"))
    ratios = checkpoint(url_ratios(distinct.select("url", "allowed", F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2)).cast("int").alias("half"), "n")))
    bias, slope = calibration(ratios)
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), bias + slope * F.col("ratio")))))
    found = join_hot(urls, ratios.select("url", "n", chance.alias("chance")), "url", "n")
    by_model = F.when(F.col("chance") >= 0.5, "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), by_model).alias("verdict"), "chance")
