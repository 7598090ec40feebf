"""Rules over rows of metrics and metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Usual image sides; cost limits (rows x features) and the algorithms that each one rules out.
IMAGE_SIDES = (8, 16, 28, 32, 64, 96, 112, 128, 224, 256, 299, 384, 512)
TIERS = ((2_000_000, ("AgglomerativeClustering", "SpectralClustering", "AffinityPropagation", "MeanShift")), (10_000_000, ("DBSCAN", "OPTICS")), (50_000_000, ("HDBSCAN", "Birch")))


def image_shape(d: str) -> Column:
    """struct(h, w, c) of a flat image of d values, or NULL: the first height near the square root that divides evenly."""
    sides = ", ".join(map(str, IMAGE_SIDES))
    for_channels = lambda ch: (
        f"if({d} >= 256 and {d} % {ch} = 0, filter(transform(filter(sequence(greatest(8, cast(round(sqrt({d} / {ch})) as int) - 8), greatest(8, cast(round(sqrt({d} / {ch})) as int) + 8)), h -> ({d} div {ch}) % h = 0), "
        f"h -> struct(cast(h as int) as h, cast(({d} div {ch}) div h as int) as w, {ch} as c)), "
        f"x -> x.w between 8 and 2048 and x.h / x.w between 0.2 and 5.0 and ({d} <= 3000 or (x.h in ({sides}) and x.w in ({sides})))), array())"
    )
    return F.expr(f"try_element_at(concat({for_channels(3)}, {for_channels(1)}), 1)")


def cost_tier(df: DataFrame, n: str = "n", d: str = "d") -> DataFrame:
    """df with cost, timeout_tier, cap_dims, downsample_to, blocked: what a data set of n x d may still be put to."""
    cost = f"cast({n} as bigint) * {d}"
    blocked = "concat(" + ", ".join(f"if({cost} >= {limit}, array({', '.join(repr(a) for a in names)}), array())" for limit, names in TIERS) + ")"
    return df.select(
        "*",
        F.expr(cost).alias("cost"),
        F.expr(f"case when {cost} >= 10000000 then 2 when {cost} >= 2000000 then 1 else 0 end").alias("timeout_tier"),
        F.expr(f"case when {cost} >= 50000000 then least(32, {d}) when {cost} >= 2000000 then least(50, {d}) else 0 end").alias("cap_dims"),
        F.expr(f"case when {cost} >= 50000000 then least(2000, greatest(500, {n} div 10)) when {cost} >= 10000000 and {n} > 20000 then 2000 end").alias("downsample_to"),
        F.expr(f"concat_ws(',', {blocked})").alias("blocked"),
    )


def modality(is_time_series: str, is_text: str, is_image: str, family: str, has_shape: str) -> Column:
    """struct(modality, metric, normalise, reduce): the first of time series, text (or sparse), image, tabular that holds."""
    return F.expr(
        f"""case when coalesce({is_time_series}, false) then struct('time_series' as modality, 'euclidean' as metric, false as normalise, if(coalesce({has_shape}, false), 'none', 'pca') as reduce)
        when coalesce({is_text}, false) or coalesce({family}, '') = 'sparse' then struct('text' as modality, 'cosine' as metric, true as normalise, 'truncated_svd' as reduce)
        when coalesce({is_image}, false) then struct('image' as modality, 'euclidean' as metric, false as normalise, 'pca' as reduce)
        else struct('tabular' as modality, 'euclidean' as metric, false as normalise, 'none' as reduce) end"""
    )


def audit_sample_size(n: str, d: str, relaxed: str = "false") -> Column:
    """Rows to audit: all up to 2,000; else a share within bounds that shrink with the number of features."""
    return F.expr(
        f"""case when {relaxed} then least({n}, 500) when {n} <= 2000 then {n}
        when {d} > 200 then least({n}, greatest(400, least(800, cast({n} * 0.06 as int)))) when {d} > 64 then least({n}, greatest(500, least(1000, cast({n} * 0.10 as int))))
        else least({n}, greatest(1000, least(2000, cast({n} * 0.15 as int)))) end"""
    )


def is_manifold(family: str, hopkins: str, risk: str, dbcv: str, d: str) -> Column:
    return F.expr(f"coalesce({family} in ('manifold', 'non_convex'), false) or coalesce({hopkins} > 0.6 and coalesce({risk}, 'low') <> 'low', false) or coalesce({dbcv} < 0, false) or coalesce({d} between 1 and 5, false)")


def verdict(stability: str, hopkins: str, k_agrees: str, dbcv: str, ari: str, k_gap: str, split: str, parts: str) -> Column:
    """struct(endorsement, action) of an audited winner."""
    return F.expr(
        f"""case
        when coalesce(abs({k_gap}) > 3 and {hopkins} < 0.3, false) or coalesce({split} > 0.5, false) or coalesce({parts} >= 3, false) then struct('qualified_with_warning' as endorsement, if(coalesce({ari} >= 0.7, false), 'CLEAR', 'RETRY') as action)
        when {stability} >= 0.75 and {hopkins} >= 0.6 and {k_agrees} and not coalesce({dbcv} < 0, false) then struct('endorsed' as endorsement, 'CLEAR' as action)
        when {stability} >= 0.5 then struct('qualified' as endorsement, if(coalesce({ari} >= 0.7, false), 'CLEAR', 'WARN') as action)
        else struct('qualified_with_warning' as endorsement, if(coalesce({ari} >= 0.7, false), 'CLEAR', 'RETRY') as action) end"""
    )


def transfer_verdict(gap: str) -> Column:
    return F.expr(f"case when {gap} > 0.15 then 'does not transfer' when {gap} > 0.07 then 'weak' else 'transfers' end")


def size_fuse(algorithms: DataFrame, rows: int, blocked: list[str] | None = None) -> DataFrame:
    """Algorithms that take this many rows (NULL max_samples: any number) and aren't blocked."""
    fits = F.col("max_samples").isNull() | (F.col("max_samples") >= rows)
    return algorithms.filter(fits & ~F.col("name").isin(blocked) if blocked else fits)


#: Algorithms that a graph winner is held against.
REFERENCES = ("KMeans", "DBSCAN", "HDBSCAN", "MiniBatchKMeans", "GMM", "GaussianMixture")


def artifact_warning(results: DataFrame, winner: str) -> DataFrame:
    """winner, reference, gap, warn: a graph winner over 0.15 ARI behind the best reference algorithm."""
    best = results.filter(F.col("algorithm").isin(*REFERENCES)).agg(F.max(F.struct("ari", "algorithm")).alias("b"))
    own = results.filter(F.col("algorithm") == winner).select(F.col("algorithm").alias("winner"), "ari")
    return own.crossJoin(best).select("winner", F.col("b.algorithm").alias("reference"), (F.col("b.ari") - F.col("ari")).alias("gap"), (F.col("b.ari") - F.col("ari") > 0.15).alias("warn"))


def ensemble_gate(best_ari: str, rescue_internal: str, endorsement: str, confidence: str, maze: str) -> Column:
    """'retreat' when no result is good enough to fuse, 'skip' when an endorsed winner needs no ensemble, else 'run'."""
    return F.expr(
        f"""case when coalesce({best_ari} < 0.2, false) or coalesce({best_ari} < 0.3 and not coalesce({rescue_internal} > 0.5, false), false) then 'retreat'
        when {maze} then 'run' when {endorsement} = 'endorsed' and {confidence} >= 0.75 then 'skip' else 'run' end"""
    )


def retry_action(max_ari: str, action: str, attempt: str) -> Column:
    """Whether an audit's RETRY is acted on: not below 0.2, not from 0.7 up, twice at most."""
    return F.expr(f"{action} = 'RETRY' and {attempt} < 2 and not coalesce({max_ari} < 0.2 or {max_ari} >= 0.7, false)")


def annealed(epoch: str, epochs: str, start: float, end: float, kind: str = "cosine") -> Column:
    """A weight that moves from start to end over the epochs."""
    share = f"least(1D, {epoch} / greatest({epochs} - 1, 1))"
    return F.expr(f"{end}D + ({start}D - {end}D) * 0.5D * (1 + cos(pi() * {share}))" if kind == "cosine" else f"{start}D + ({end}D - {start}D) * {share}")
