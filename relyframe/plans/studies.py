"""Pre-registered comparisons as tables: designs, verdicts, ablations, variants and their roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.operators.caps import species_mean
from relyframe.operators.partition import assert_no_leakage, variants_missing
from relyframe.operators.scoring import CELL, correlations, coverage, fp_by_species, fp_overall, quantile_bins
from relyframe.plans.association import bootstrap_corr, bootstrap_partial, line_validation
from relyframe.plans.grid import oos_grid
from relyframe.plans.models import Design, cv_summary, shapley_r2
from relyframe.sources.scratch import stored

SCHEMES = {"species": "category_id", "location": "location_id"}


def merge_features(cells: DataFrame, per_species: list[DataFrame] = (), per_location: list[DataFrame] = (), per_cell: list[DataFrame] = ()) -> DataFrame:
    """Cells with features joined at their grain; rows are kept as they are. Raises ValueError if a feature has two rows a key."""
    grains = ((["category_id"], per_species), (["location_id"], per_location), (CELL, per_cell))
    return merge_features_at(cells, [(f, keys) for keys, features in grains for f in features])


def merge_features_at(cells: DataFrame, features: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Cells with (feature, keys) joined, written by one job.

    That job groups each feature by its keys and fails where a key has two rows, so no feature is read a second time to test it.
    """
    for feature, keys in features:
        cells = cells.join(_single(feature, keys), keys, "left")
    try:
        return stored(cells)
    except Exception as e:
        if _TWICE in str(e):
            raise ValueError(str(e)[str(e).index(_TWICE) :].split("\n")[0]) from e
        raise


_TWICE = "a feature has more than one row a"


def _single(feature: DataFrame, keys: list[str]) -> DataFrame:
    """The feature with a failure in place of the values of a key that occurs twice."""
    names = [c for c in feature.columns if c not in keys]
    grouped = feature.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.min_by(c, F.lit(0)).alias(c) for c in names))
    fails = F.raise_error(F.lit(f"{_TWICE} {keys}"))
    return grouped.select(*keys, *(F.when(F.col("_n") > 1, fails.cast(feature.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in names))


def assemble_features(cells: DataFrame, partition: DataFrame, held_axis: str, loso: bool, **features: list[DataFrame]) -> DataFrame:
    """Feature table of one partition, after its firewall."""
    assert_no_leakage(partition, held_axis, loso)
    return merge_features(cells, **features)


def run_designs(cells: DataFrame, designs: list[Design], targets: list[str], support: str | None, draws: int, schemes: dict[str, str] = SCHEMES, seed: int = 0) -> DataFrame:
    """(design, group_scheme, target, n, mae, baseline_mae, delta, delta_lo, delta_hi, p_value, significant)."""
    oos, _ = oos_grid(cells, designs, targets, support, schemes, CELL)  # one grid: all share each scan
    return cv_summary(oos, ["design", "group_scheme", "target"], draws, seed)


def verdicts(summary: DataFrame, n_tests: int, by: list[str] = ("design",), schemes: int = 2) -> DataFrame:
    """(by, both_positive, both_significant): over all schemes; false where a scheme is missing."""
    whole = F.count_distinct("group_scheme") == schemes
    sure = F.bool_and(F.coalesce(F.col("p_value") < 0.05 / n_tests, F.lit(False)))
    return summary.groupBy(*by).agg((whole & F.bool_and(F.col("delta") > 0)).alias("both_positive"), (whole & sure).alias("both_significant"))


def size_carries(summary: DataFrame, size_only: str, feature_only: str) -> DataFrame:
    """One row: whether the size design validates at 5 % on both schemes and the feature alone does not."""
    held = verdicts(summary, 1)
    return held.agg((F.coalesce(F.bool_or(F.when(F.col("design") == size_only, F.col("both_significant"))), F.lit(False)) & ~F.coalesce(F.bool_or(F.when(F.col("design") == feature_only, F.col("both_significant"))), F.lit(False))).alias("size_carries"))


def head_to_head(summary: DataFrame, challenger: str, base: str) -> DataFrame:
    """(group_scheme, target, gain): the challenger's delta less the base's."""
    pick = lambda name, out: summary.filter(F.col("design") == name).select("group_scheme", "target", F.col("delta").alias(out))
    return pick(challenger, "a").join(pick(base, "b"), ["group_scheme", "target"]).select("group_scheme", "target", (F.col("a") - F.col("b")).alias("gain"))


def sorted_summary(summary: DataFrame) -> DataFrame:
    """A validation summary in the order of its scheme and target."""
    return summary.orderBy("group_scheme", "target")


def experiment(cells: DataFrame, designs: list[Design], target: str, support: str | None, draws: int, n_tests: int | None = None) -> DataFrame:
    """The designs' validation rows, each with its verdict over the schemes at 5 % over ``n_tests`` (the designs' number)."""
    summary = stored(run_designs(cells, designs, [target], support, draws))
    return summary.join(verdicts(summary, n_tests or len(designs)), "design")


def confidence_experiment(cells: DataFrame, signals: list[str], size: str, target: str, support: str | None, draws: int) -> DataFrame:
    """After-running estimators: each confidence signal alone, controlled for size; the first is the primary one."""
    designs = [Design(s, (s, size), support=True) for s in signals]
    return experiment(cells, designs, target, support, draws).withColumn("is_primary", F.col("design") == signals[0])


def difficulty_experiment(cells: DataFrame, continuous: list[str], binary: list[str], size: str, target: str, support: str | None, draws: int) -> tuple[DataFrame, DataFrame]:
    """(verdicts of the single signals and of all together, size decomposition with ``size_carries``).

    Signals are controlled for size and tested at 5 % over their number. The nested designs tell whether size alone
    carries the gain: support only, size only, the first signal without size, and with it.
    """
    single = [Design(c, (c, size), support=True) for c in continuous] + [Design(b, (size,), (b,), support=True) for b in binary]
    both = Design("combined", (*continuous, size), tuple(binary), support=True)
    first = continuous[0]
    nested = [Design("support_only", support=True), Design("size_only", (size,), support=True), Design("first_only", (first,), support=True), Design("first_plus_size", (first, size), support=True)]
    parts = stored(run_designs(cells, nested, [target], support, draws))
    found = experiment(cells, [*single, both], target, support, draws, len(single))
    return found, parts.crossJoin(size_carries(parts, "size_only", "first_only"))  # one row


def familiarity_experiment(cells: DataFrame, metrics: list[str], base: str, size: str, target: str, support: str | None, draws: int) -> tuple[DataFrame, DataFrame]:
    """(verdicts of the metrics, a row a metric: gain over base and size on each scheme, ``adds``, correlations).

    A metric adds over the base distance with size if its gain on the species scheme exceeds theirs and is significant.
    """
    found = experiment(cells, [Design(m, (m, size), support=True) for m in metrics], target, support, draws)
    base_design = Design("base", (base, size), support=True)
    joint = [Design(m, (m, base, size), support=True) for m in metrics]
    summary = stored(run_designs(cells, [base_design, *joint], [target], support, draws))
    gains = reduce(DataFrame.unionByName, [head_to_head(summary, m, "base").withColumn("design", F.lit(m)) for m in metrics])
    gains = gains.join(summary.select("design", "group_scheme", "p_value"), ["design", "group_scheme"])
    pick = lambda c, scheme: F.max(F.when(F.col("group_scheme") == scheme, F.col(c)))
    gains = gains.groupBy("design").agg(
        *(pick("gain", s).alias(f"gain_{s}") for s in SCHEMES),
        F.coalesce(pick("gain", "species") > 1e-4, F.lit(False)).alias("more"),
        F.coalesce(pick("p_value", "species") < 0.05, F.lit(False)).alias("sure"),
    )
    corr = correlations(cells, metrics, [base, size]).groupBy("feature").pivot("target", [base, size]).agg(F.first("r"))
    corr = corr.select(F.col("feature").alias("design"), F.col(base).alias("r_base"), F.col(size).alias("r_size"))
    gains = gains.withColumn("adds", F.col("more") & F.col("sure")).drop("more", "sure")
    return found, gains.join(corr, "design", "left")


def replace_feature(cells: DataFrame, feature: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the feature's columns replaced by those of another partition, at its keys; null where that has none."""
    columns = [c for c in feature.columns if c not in keys]
    return merge_features_at(cells.drop(*columns), [(feature, keys)])


def robustness(variants: dict[str, DataFrame], wanted: DataFrame, design: Design, targets: list[str], support: str, draws: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary by variant, verdicts with m = tested variants, variants that are missing)."""
    parts = [run_designs(cells, [design], targets, support, draws).withColumn("variant", F.lit(name)) for name, cells in variants.items()]
    summary = reduce(DataFrame.unionByName, parts)
    return summary, verdicts(summary, len(variants), ["variant"]), variants_missing(wanted, summary)


def model_swap(features: DataFrame, other_scores: DataFrame, designs: list[Design], targets: list[str], support: str, draws: int) -> DataFrame:
    """The designs with another tracker's targets on the same cells and features."""
    swapped = features.drop(*targets).join(other_scores.select(*CELL, *targets), CELL)
    return run_designs(swapped, designs, targets, support, draws)


def ablation_designs(factors: list[str], size: str) -> list[Design]:
    """Full, each factor dropped, plus size, and without support."""
    full = tuple(factors)
    drops = [Design(f"drop_{f}", tuple(x for x in full if x != f), support=True) for f in full]
    return [Design("full", full, support=True), *drops, Design("plus_size", (*full, size), support=True), Design("no_support", full)]


def ablation(cells: DataFrame, target: str, factors: list[str], size: str, support: str, draws: int) -> DataFrame:
    """(design, group_scheme, delta, p_value, pseudo_r2) of the ablation designs."""
    oos, fits = oos_grid(cells, ablation_designs(factors, size), [target], support, SCHEMES, CELL)
    r2 = [(f.item.design.name, float(f.pseudo_r2)) for f in fits if f.item.scheme == "species"]
    r2 = cells.sparkSession.createDataFrame(r2, "design string, pseudo_r2 double")
    summary = cv_summary(oos, ["design", "group_scheme", "target"], draws)
    return summary.join(r2, "design").select("design", "group_scheme", "delta", "p_value", "pseudo_r2")


def variance_partition(cells: DataFrame, targets: list[str], factors: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [shapley_r2(cells, t, factors).withColumn("target", F.lit(t)) for t in targets])


def replication(cells: DataFrame, designs: list[Design], target: str, support: str, full_taxonomy: DataFrame, collapse: str, draws: int) -> DataFrame:
    """The designs on all cells, on species with a full taxonomy, and with one column at its species mean."""
    complete = cells.join(full_taxonomy.select("category_id").distinct(), "category_id", "left_semi")
    tables = {"all": cells, "full_taxonomy": complete, "species_mean": species_mean(cells, collapse)}
    return reduce(DataFrame.unionByName, [run_designs(t, designs, [target], support, draws).withColumn("subset", F.lit(n)) for n, t in tables.items()])


def false_positive_study(fp: DataFrame, distance: str, size: str, draws: int) -> dict[str, DataFrame]:
    """Tables of the false-positive study over hard negatives with ``fp``, ``n_pred``, a distance and a size."""
    species = fp_by_species(fp.withColumn("distance", F.col(distance))).join(fp.groupBy("category_id").agg(F.min(size).alias(size)), "category_id")
    return {
        "species": species,
        "overall": fp_overall(fp),
        "terciles": quantile_bins(fp.withColumn("rate", F.col("fp").cast("double")), distance, "rate"),
        "correlation": bootstrap_corr(species, "category_id", "distance", "fp_rate", "n", draws),
        "partial": bootstrap_partial(species, "category_id", "distance", "fp_rate", size, "n", draws),
        "predictor": line_validation(species, "category_id", "distance", "fp_rate", "n", draws),
    }


def roll_up(summary: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Headline numbers as (section, metric, value, lo, hi, p, n) rows."""
    none = F.lit(None).cast("double")
    gains = summary.select(F.lit("validation").alias("section"), F.concat_ws("/", "design", "group_scheme", "target").alias("metric"), F.col("delta").alias("value"), F.col("delta_lo").alias("lo"), F.col("delta_hi").alias("hi"), F.col("p_value").alias("p"), F.col("n").alias("n"))
    real = coverage(cells, columns).select(F.lit("coverage").alias("section"), F.col("column").alias("metric"), F.col("n_real").cast("double").alias("value"), none.alias("lo"), none.alias("hi"), none.alias("p"), F.col("n_rows").alias("n"))
    return gains.unionByName(real)
