"""Bundles of metrics by location: schemas, minimum observations, subsets and status codes."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import correlation, covariance_cells, deviation_totals, evaluate, known, pair_moments, power_of_two, reach, rounded_middle
from ..functions.special import correlation_p
from . import intervals, ranks, scaling, triple
from .splits import apart

#: Status codes. Fixed values.
UNCAUGHT, OK, INSUFFICIENT_DATA, METRICS_FAILED, MATCHING_FAILED, NO_MATCHED_DATA, SCALING_FAILED, VALIDATION_FAILED, NO_DATA, DATA_MANAGER_FAILED = -1, 0, 1, 2, 3, 4, 5, 6, 7, 8

SEASONS: dict[str, tuple[int, ...]] = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11), "ALL": tuple(range(1, 13))}

Calculator = Callable[[DataFrame, list[str]], DataFrame]


def status_of(n: Column, min_obs: int, failed: Column | None = None) -> Column:
    """INT status: no matched data, too few rows, failed metrics, or fine."""
    out = F.when(n == 0, NO_MATCHED_DATA).when(n < min_obs, INSUFFICIENT_DATA)
    return (out.when(failed, METRICS_FAILED) if failed is not None else out).otherwise(OK).cast("int")


def _guarded(columns: Iterable[Column], names: Iterable[str], enough: Column) -> list[Column]:
    return [F.when(enough, c).alias(n) for c, n in zip(columns, names, strict=True)]


def basic(x: str = "ref", y: str = "k1", calc_tau: bool = False, mse: bool = False, min_obs: int = 10) -> Calculator:
    """n_obs, R, p_R, rho, p_rho, RMSD, BIAS, with tau on demand, and the parts of the mean squared difference with mse."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        m = df.groupBy(*keys).agg(*pair_moments(x, y))
        enough = F.col("n") >= min_obs
        names = {"R": "pearson_r", "RMSD": "rmsd", "BIAS": "bias"} | ({"mse": "mse", "mse_corr": "mse_corr", "mse_bias": "mse_bias", "mse_var": "mse_var"} if mse else {})
        out = m.select(*keys, F.col("n").cast("int").alias("n_obs"), *_guarded(evaluate(names.values()), names, enough), status_of(F.col("n"), min_obs).alias("status"))
        out = out.withColumn("p_R", correlation_p(F.col("R"), F.col("n_obs").cast("double")))
        rho = ranks.spearman(df, x, y, keys).select(*keys, F.col("rho").alias("__rho"), F.col("p_rho").alias("__p"), F.col("n_obs").alias("__n"))
        out = out.join(rho, keys, "left")
        out = out.select(*(c for c in out.columns if not c.startswith("__")), F.when(F.col("__n") >= min_obs, F.col("__rho")).alias("rho"), F.when(F.col("__n") >= min_obs, F.col("__p")).alias("p_rho"))
        if calc_tau:
            tau = ranks.kendall(df, x, y, keys).filter(F.col("n_obs") >= min_obs).drop("n_obs")
            out = out.join(tau, keys, "left")
        return out

    return run


def freeze_thaw(ref: str = "ref", temperature: str = "k1", frozen_flag: int = 2) -> Calculator:
    """The four counts of frozen or not by the flag against temperatures below zero or not; missing temperatures count nowhere."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        frozen, t = F.col(ref) == frozen_flag, known(temperature)
        cells = {"ssf_fr_temp_un": frozen & (t < 0), "ssf_fr_temp_ab": frozen & (t >= 0), "ssf_un_temp_un": ~frozen & (t < 0), "ssf_un_temp_ab": ~frozen & (t >= 0)}
        return df.groupBy(*keys).agg(*(F.count_if(c).cast("int").alias(k) for k, c in cells.items()), F.count(F.lit(1)).cast("int").alias("n_obs"))

    return run


def pairwise(x: str, y: str, min_obs: int = 10, calc_spearman: bool = True, calc_kendall: bool = False, analytical_cis: bool = True, bootstrap_cis: bool = False, bootstrap_min_obs: int = 100, bootstrap_alpha: float = 0.05, seed: int = 0) -> Calculator:
    """BIAS, mse with its parts, RSS, RMSD, urmsd, R with p, rho, tau, and intervals <metric>_ci_lower and _upper.

    The moments are added up once, for the metrics and their analytical intervals; rank correlations and the bootstrap, each
    one more pass over a key's rows, are joined.
    """

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        m = df.groupBy(*keys).agg(*pair_moments(x, y))
        enough = F.col("n") >= min_obs
        names = {"BIAS": "bias", "mse": "mse", "mse_corr": "mse_corr", "mse_var": "mse_var", "mse_bias": "mse_bias", "RSS": "rss", "RMSD": "rmsd", "urmsd": "ubrmsd", "R": "pearson_r"}
        ends = []
        for metric, name in (("bias", "BIAS"), ("ubrmsd", "urmsd"), ("pearson_r", "R")) if analytical_cis else ():
            _, low, high = intervals.moment_interval(metric)
            ends += _guarded((low, high), (f"{name}_ci_lower", f"{name}_ci_upper"), enough)
        out = m.select(*keys, F.col("n").cast("int").alias("n_obs"), *_guarded(evaluate(names.values()), names, enough), *ends, status_of(F.col("n"), min_obs).alias("status"))
        out = out.withColumn("p_R", correlation_p(F.col("R"), F.col("n_obs").cast("double")))

        def add(found: DataFrame, columns: dict[str, str]) -> None:
            nonlocal out
            picked = found.filter(F.col("n_obs") >= min_obs).select(*keys, *(F.col(a).alias(b) for a, b in columns.items()))
            out = out.join(picked, keys, "left")

        if calc_spearman:
            add(ranks.spearman(df, x, y, keys), {"rho": "rho", "p_rho": "p_rho"})
        if calc_kendall:
            add(ranks.kendall(df, x, y, keys), {"tau": "tau", "p_tau": "p_tau"})
        if analytical_cis:
            for name, kind, on in (("rho", "spearman_r", calc_spearman), ("tau", "kendall_tau", calc_kendall)):
                if on:
                    low, high = intervals.fisher_interval(F.col(name), F.col("n_obs"), 0.05, intervals.rank_factor(kind, F.col(name)))
                    out = out.withColumn(f"{name}_ci_lower", low).withColumn(f"{name}_ci_upper", high)
        if bootstrap_cis:
            sampled = {"mse": "msd", "mse_corr": "mse_corr", "mse_var": "mse_var", "mse_bias": "mse_bias", "RMSD": "rmsd"}
            found = intervals.bootstrapped_many(df, x, y, sampled, keys, bootstrap_alpha, minimum_data_length=bootstrap_min_obs, seed=seed)
            add(found, {f"{n}_{end}": f"{n}_ci_{end}" for n in sampled for end in ("lower", "upper")})
        return out

    return run


def triple_collocation(columns: list[str], refname: str, min_obs: int = 10, bootstrap_cis: bool = False, bootstrap_min_obs: int = 100, bootstrap_alpha: float = 0.05, seed: int = 0) -> Calculator:
    """One row for each dataset: snr, err_std and beta, with intervals on demand; status 2 where a metric is undefined."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        out = triple.triple_collocation(df, columns, keys, refname, min_obs=min_obs)
        failed = F.col("snr").isNull() | F.col("err_std").isNull() | F.col("beta").isNull()
        out = out.withColumn("status", status_of(F.col("n_obs"), min_obs, failed))
        if bootstrap_cis:
            boot = intervals.bootstrapped_triple(df, columns, keys, refname, bootstrap_alpha, minimum_data_length=bootstrap_min_obs, seed=seed)
            ends = boot.groupBy(*keys, "dataset").pivot("metric", ["snr", "err_std", "beta"]).agg(F.first("lower").alias("ci_lower"), F.first("upper").alias("ci_upper"))
            out = out.join(ends, [*keys, "dataset"], "left")
        return out

    return run


def intercomparison(columns: list[str], refname: str, metrics_between_nonref: bool = False, calc_tau: bool = False, calc_rho: bool = True, min_obs: int = 10) -> Calculator:
    """Wide rows: every metric of every pair as m_between_a_and_b; pairs without the reference on demand. urmsd is that of
    series scaled by mean and deviation."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        full = df.dropna(subset=columns)
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if metrics_between_nonref or refname in (a, b)]
        aggregates: list[Column] = [F.count(F.lit(1)).alias("n_obs")]
        for a, b in pairs:
            aggregates += pair_moments(a, b, f"{a}|{b}|")
        m = full.groupBy(*keys).agg(*aggregates)
        enough, out = F.col("n_obs") >= min_obs, []
        for a, b in pairs:
            p = f"`{a}|{b}|"

            def at(name, p=p):
                return F.col(f"{p}{name}`")

            r = correlation(*(at(c) for c in ("vx", "vy", "cxy", "mx", "my")))
            cells = {
                "R": r,
                "rmsd": F.sqrt(at("rss") / F.nullif(at("n"), F.lit(0))),
                "mse": at("rss") / F.nullif(at("n"), F.lit(0)),
                "bias": at("mx") - at("my"),
                "mse_bias": (at("mx") - at("my")) * (at("mx") - at("my")),
                "mse_var": F.pow(F.sqrt(at("vx")) - F.sqrt(at("vy")), F.lit(2.0)),
                "mse_corr": F.greatest(2 * F.sqrt(at("vx")) * F.sqrt(at("vy")) - 2 * at("cxy"), F.lit(0.0)),
                "urmsd": F.sqrt(F.greatest(2 * at("vx") * (1 - r), F.lit(0.0))),
                "rss": at("rss"),
            }
            out += [F.when(enough, c).alias(f"{k}_between_{a}_and_{b}") for k, c in cells.items()]
        found = m.select(*keys, F.col("n_obs").cast("int").alias("n_obs"), *out)
        if calc_rho:
            found = found.join(ranks.spearman_of_pairs(full, pairs, keys).drop("n_obs"), keys, "left")
        for a, b in pairs:
            for name in ("R", "rho") if calc_rho else ("R",):
                found = found.withColumn(f"p_{name}_between_{a}_and_{b}", correlation_p(F.col(f"{name}_between_{a}_and_{b}"), F.col("n_obs").cast("double")))
            if calc_tau:
                got = ranks.kendall(full, a, b, keys).select(*keys, *(F.col(n).alias(f"{n}_between_{a}_and_{b}") for n in ("tau", "p_tau")))
                found = found.join(got, keys, "left")
        return found

    return run


def subsets(calculator: Calculator, members: dict[str, Callable[[Column], Column]], ts: str = "ts") -> Calculator:
    """The calculator for every subset of time (a predicate of the time stamp); subsets may overlap. Adds a column `subset`."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        labels = F.array_compact(F.array(*(F.when(p(F.col(ts)), F.lit(name)) for name, p in members.items())))
        return calculator(df.withColumn("subset", F.explode(labels)), [*keys, "subset"])

    return run


def months(calculator: Calculator, month_subsets: dict[str, tuple[int, ...]] | None = None, ts: str = "ts") -> Calculator:
    """The calculator for seasons (or other sets of months) and for all the year."""
    chosen = SEASONS if month_subsets is None else month_subsets
    return subsets(calculator, {name: lambda c, m=m: F.month(c).isin(*m) for name, m in chosen.items()}, ts)


def triple_and_pairs(columns: list[str], refname: str, metrics_between_nonref: bool = False, calc_tau: bool = False, min_obs: int = 10) -> Calculator:
    """The intercomparison's wide rows with snr, err_std and beta of every triple that has the reference."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        out = intercomparison(columns, refname, metrics_between_nonref, calc_tau, min_obs=min_obs)(df, keys)
        full = df.dropna(subset=columns)
        for combo in itertools.combinations(columns, 3):
            if refname in combo:
                got = triple.triple_collocation(full, list(combo), keys, refname, min_obs=min_obs)
                name = "_and_".join(combo)
                for c in combo:
                    part = got.filter(F.col("dataset") == c).select(*keys, *(F.col(m).alias(f"{m}_{c}_between_{name}") for m in ("snr", "err_std", "beta")))
                    out = out.join(part, keys, "left")
        return out

    return run


def seasonal_triple(columns: list[str], refname: str, min_obs: int = 3, ts: str = "ts") -> Calculator:
    """By season and for all the year: triple metrics of each dataset, and R, rho, bias and ubrmsd of each pair.

    Pairs are compared after scaling the second to the first by extrema. Rows have a dataset or a pair, the other is null.
    A key (of df, with all its seasons) is whole in a task, so that the rows are exchanged once and nothing is written; what
    a key with very many rows needs is computed metric by metric, each split over tasks.
    """
    pairs_of = list(itertools.combinations(columns, 2))

    def pairs(df: DataFrame, keys: list[str]) -> DataFrame:
        parts = []
        for a, b in pairs_of:
            scaled = scaling.scaled(df.select(*keys, a, b), b, a, "min_max", keys)
            m = scaled.groupBy(*keys).agg(*pair_moments(a, b))
            enough = F.col("n") >= min_obs
            got = m.select(*keys, F.col("n").alias("n_obs"), *_guarded(evaluate(("pearson_r", "bias", "ubrmsd")), ("R", "bias", "ubrmsd"), enough), status_of(F.col("n"), min_obs).alias("status"))
            rho = ranks.spearman(scaled, a, b, keys, with_p=False).select(*keys, "rho")
            parts.append(got.join(rho, keys, "left").withColumn("pair", F.lit(f"{a}_and_{b}")))
        return reduce(DataFrame.unionByName, parts)

    def split(rows: DataFrame, keys: list[str]) -> DataFrame:
        both = months(triple_collocation(columns, refname, min_obs), ts=ts)(rows, keys), months(pairs, ts=ts)(rows, keys)
        return both[0].unionByName(both[1], allowMissingColumns=True)

    def whole(rows: DataFrame, keys: list[str], tasks: int) -> DataFrame:
        by, of = [*keys, "subset"], range(len(columns))
        places = [(columns.index(a), columns.index(b)) for a, b in pairs_of]
        x = [F.col(f"__x{i}") for i in of]
        dealt = rows.select(*keys, F.month(ts).cast("byte").alias("__month"), *(known(c).alias(f"__x{i}") for i, c in enumerate(columns))).repartition(tasks, *keys)
        labels = F.array_compact(F.array(*(F.when(F.col("__month").isin(*m), F.lit(name)) for name, m in SEASONS.items())))
        found = dealt.select(*keys, F.explode(labels).alias("subset"), *x)

        # what all rows of a key and subset need to know: the middles and units of covariances, and the scaled values
        full = reduce(Column.__and__, (v.isNotNull() for v in x))
        every = Window.partitionBy(*by).orderBy("__x0").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = found.withColumns({"n": F.count(F.when(full, 1)).over(every)} | {f"__{name}{i}": f(F.when(full, x[i])).over(every) for i in of for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))} | {f"__{name}{i}": f(x[i]).over(every) for i in of for name, f in (("low", F.min), ("high", F.max))})
        stats = [{f"{name}_{'xy'[k]}": F.col(f"__{end}{i}") for k, i in enumerate((b, a)) for name, end in (("min", "low"), ("max", "high"))} for a, b in places]
        middles = [rounded_middle(*(F.col(f"__{e}{i}") for e in ("avg", "min", "max"))) for i in of]
        to = [known(scaling.MOMENT_METHODS["min_max"](x[b], got.__getitem__)) for (_, b), got in zip(places, stats, strict=True)]
        found = found.select(*by, *x, "n", *(m.alias(f"__m{i}") for i, m in enumerate(middles)), *(reach(m, F.col(f"__min{i}"), F.col(f"__max{i}")).alias(f"__far{i}") for i, m in enumerate(middles)), *(y.alias(f"__y{p}") for p, y in enumerate(to)))

        both = [x[a].isNotNull() & F.col(f"__y{p}").isNotNull() for p, (a, _) in enumerate(places)]
        for i in of:
            found = ranks.ranks_in_order(found, by, f"__x{i}", {f"__r{p}_{i}": both[p] for p, pair in enumerate(places) if i in pair})
        # covariances are those of rows in which all is known
        found = found.select(*by, "n", *(F.when(full, v).alias(f"__x{i}") for i, v in enumerate(x)), *(f"__{e}{i}" for i in of for e in ("m", "far")), *(c for p, (a, b) in enumerate(places) for c in (F.when(both[p], x[a]).alias(f"__a{p}"), f"__y{p}", f"__r{p}_{a}", f"__r{p}_{b}")), (power_of_two(F.col("n")) * 1.5).alias("__n"), F.lit(1).alias("__w"))
        moments = []
        for p, (a, b) in enumerate(places):
            moments += pair_moments(f"__a{p}", f"__y{p}", f"__p{p}_")
            moments.append(ranks.rank_correlation(F.count(F.col(f"__a{p}")), f"__r{p}_{a}", f"__r{p}_{b}").alias(f"__rho{p}"))
        m = found.groupBy(*by).agg(*deviation_totals(len(columns)), *moments)

        m = m.select("*", *covariance_cells(len(columns)))
        e = triple.triple_expressions(lambda i, j: F.col(f"c_{min(i, j)}_{max(i, j)}"), columns.index(refname))
        out, n = [], F.col("n")
        for i, c in enumerate(columns):
            cells = {k: F.when(n >= min_obs, v[i]) for k, v in e.items()}
            failed = reduce(Column.__or__, (v.isNull() for v in cells.values()))
            out.append({"dataset": F.lit(c), "n_obs": n, **cells, "status": status_of(n, min_obs, failed)})
        for p, (a, b) in enumerate(pairs_of):
            n = F.col(f"__p{p}_n")
            cells = dict(zip(("R", "bias", "ubrmsd"), evaluate(("pearson_r", "bias", "ubrmsd"), f"__p{p}_"), strict=True))
            out.append({"n_obs": n, "status": status_of(n, min_obs), **{k: F.when(n >= min_obs, v) for k, v in cells.items()}, "rho": F.col(f"__rho{p}"), "pair": F.lit(f"{a}_and_{b}")})
        kinds = {"dataset": "string", "n_obs": "long", "snr": "double", "err_std": "double", "beta": "double", "status": "int", "R": "double", "bias": "double", "ubrmsd": "double", "rho": "double", "pair": "string"}
        each = F.explode(F.array(*(F.struct(*(r.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items())) for r in out)))
        return m.select(*by, each.alias("__r")).select(*by, "__r.*")

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = df.dropna(subset=columns)
        few, many, tasks = apart(rows, keys, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")))
        # a row is two there, and wide: a task is meant to have a quarter of the usual share
        found = whole(few, keys, max(4 * tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        return found if many is None else found.unionByName(split(many, keys))

    return run


def with_metadata(calculator: Calculator, locations: DataFrame, fields: list[str], keys: list[str] | None = None) -> Calculator:
    """Joins lon, lat and other fields of a location table; fields that it lacks are an error, locations without any stay null."""
    missing = [c for c in fields if c not in locations.columns]
    if missing:
        raise ValueError(f"the location table has no {', '.join(missing)}")

    def run(df: DataFrame, by: list[str]) -> DataFrame:
        on = [k for k in (keys or ["loc_id"]) if k in by]
        return calculator(df, by).join(locations.select(*on, *fields), on, "left")

    return run
