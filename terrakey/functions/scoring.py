"""Verdicts, intervals and labels of matching runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, within 0 to 1; null without trials."""
    p = F.try_divide(k.cast("double"), n)
    zz = z * z
    scale = 1 + F.try_divide(F.lit(zz), n)
    mid = (p + F.try_divide(F.lit(zz), 2 * n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(zz), 4 * n * n)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def verdict_gt(has_model: Column, degenerate: Column, n_inliers: Column, err: Column) -> Column:
    """Verdict where the true map is known; a missing error is no success, a degenerate fit at most marginal."""
    success = has_model & ~degenerate & (n_inliers >= 15) & (err <= 2)
    return F.when(success, "SUCCESS").when(has_model & (n_inliers >= 8) & (err <= 10), "MARGINAL").otherwise("FAILURE")


def confirmed_by(agree_px: Column, other_usable: Column, ncc_gain: Column) -> Column:
    """What confirms a run without known truth: the other method, or a better image correlation if there is no other."""
    return F.when((agree_px <= 3) & other_usable, "agreement").when((ncc_gain >= 0.05) & ~other_usable, "ncc")


def verdict_real(has_model: Column, n_inliers: Column, heldout: Column, confirmed: Column) -> Column:
    """Verdict without known truth, by the error on held-out matches and what confirms the map."""
    success = has_model & (n_inliers >= 15) & (heldout <= 2) & confirmed.isNotNull()
    return F.when(success, "SUCCESS").when(has_model & (n_inliers >= 8) & (heldout <= 5), "MARGINAL").otherwise("FAILURE")


def usable_arm(has_model: Column, degenerate: Column, n_inliers: Column) -> Column:
    return has_model & ~degenerate & (n_inliers >= 8)


def accepted_arm(degenerate: Column, n_inliers: Column, err: Column) -> Column:
    """Whether a policy may take an arm: it has a known error, enough inliers and a sound fit."""
    return err.isNotNull() & (n_inliers >= 15) & ~degenerate


def coverage_class(density: Column) -> Column:
    return F.when(density > 0.40, "high").when(density > 0.12, "medium").otherwise("low")


def uniformity_label(u: Column) -> Column:
    return F.when(u > 0.70, "excellent").when(u > 0.50, "good").when(u > 0.30, "fair").otherwise("poor")


def tone(value: Column, good: float, fair: float, larger_is_better: bool) -> Column:
    if larger_is_better:
        return F.when(value > good, "good").when(value > fair, "ok").otherwise("bad")
    return F.when(value < good, "good").when(value < fair, "ok").otherwise("bad")


def run_tones(rmse: Column, inlier_ratio: Column, truth: Column, degenerate: Column) -> dict[str, Column]:
    """Tones of a run's figures, and a warning where the true error at the corners belies a fit that looks sound; no tone without truth."""
    return {
        "rmse_tone": F.when(degenerate, "bad").otherwise(tone(rmse, 1, 3, False)),
        "ratio_tone": tone(inlier_ratio, 0.5, 0.25, True),
        "truth_tone": F.when(truth.isNotNull(), tone(truth, 3, 15, False)),
        "warning": F.coalesce((truth > 15) & ~degenerate, F.lit(False)),
    }


def table_line(title: Column, detector: Column, n_inliers: Column, n_matches: Column, rmse: Column, truth: Column) -> tuple[Column, Column]:
    """A run as a line of a table, and whether its true error is that of a wrong map."""
    wrong = F.coalesce(truth > 50, F.lit(False))
    shown = F.coalesce(F.format_string("%.2f", truth), F.lit("n/a"))
    shown = F.when(truth.isNull(), "n/a").otherwise(shown)
    flag = F.when(wrong, "  **<- wrong**").otherwise("")
    counts = F.concat(n_inliers.cast("string"), F.lit("/"), n_matches.cast("string"))
    return F.concat(F.lit("| "), title, F.lit(" | "), detector, F.lit(" | "), counts, F.lit(" | "), F.format_string("%.3f", rmse), F.lit(" | "), shown, flag, F.lit(" |")), wrong


def lock_decision(peak: Column, ratio: Column, z: Column, shift_m: Column, tile_px: int, gsd: Column) -> Column:
    """Accept the measured lock, keep the prior position, or reject."""
    sure = (peak >= 0.20) & ((ratio >= 1.8) | (z >= 6))
    return F.when(sure, "measured").when(shift_m <= 0.35 * tile_px * gsd, "prior").otherwise("rejected")
