"""Shared building blocks: keys, ordered totals, quantiles, stencils, checkpoints, Gram matrices."""
