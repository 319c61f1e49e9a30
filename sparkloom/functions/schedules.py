"""Step schedules and per-sample penalties as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def warmup_steps(ratio: float, max_steps: int) -> int:
    return math.ceil(ratio * max_steps)


def target_schedule(step: Column, start: Column, end: Column, warmup: int) -> Column:
    """Linear ramp from start to end during warm-up, then the end value."""
    ramp = start + (end - start) * (step / F.lit(max(warmup, 1)))
    return F.when(step < warmup, ramp).otherwise(end)


def tau_schedule(step: Column, max_steps: int, high: float = 1.5, low: float = 1.0, share: float = 0.6) -> Column:
    """Cosine fall from high to low over a share of the steps, then low."""
    decay = math.ceil(max_steps * share)
    wave = F.lit(low) + F.lit(0.5 * (high - low)) * (1 + F.cos(F.lit(math.pi) * step / F.lit(max(decay, 1))))
    return F.when(step < decay, wave).otherwise(F.lit(float(low)))


def lr_floor(step: Column, factor: Column, floor: float, warmup: int) -> Column:
    """Learning-rate factor, lifted to a floor after warm-up."""
    return F.when(step < warmup, factor).otherwise(F.lit(floor) + factor * F.lit(1.0 - floor))


def stripe_value(layer: Column, width_1: int, width_2: int, start_with_keep: bool = True, high: float = 10.0) -> Column:
    """High for the first ``width_1`` layers of each period, low for the next ``width_2``."""
    first = F.lit(high if start_with_keep else -high)
    return F.when(F.pmod(layer, F.lit(width_1 + width_2)) < width_1, first).otherwise(-first)


def gap_penalty(actual: Column, target: Column, lambda1: Column, lambda2: Column) -> Column:
    """Absolute and squared distance to the target, weighted."""
    gap = actual - target
    return lambda1 * F.abs(gap) + lambda2 * gap * gap


def route_entropy(p: Column, binary: bool = False, eps: float = 1e-8) -> Column:
    """-p ln(p), of the full-path share only or of both sides."""
    kept = -p * F.log(p + eps)
    return kept - (1 - p) * F.log(1 - p + eps) if binary else kept


def gated_blend(gate: Column, a: Column, b: Column) -> Column:
    """gate * a + (1 - gate) * b, element by element."""
    return F.zip_with(a, b, lambda x, y: gate * x + (1 - gate) * y)


def or_zero_without_labels(loss: Column, valid: Column) -> Column:
    """0 instead of a mean over nothing."""
    return F.when(valid == 0, F.lit(0.0)).otherwise(loss)
