"""Scalar expressions of training runs and token files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the schedule and the peak of the accelerator that utilisation is measured against
WARMUP, DECAY, MIN_LR, PEAK_FLOPS = 200, 600_000, 6e-5, 312e12


def dtype_choice(max_token: Column) -> Column:
    return F.when(max_token.isNull(), "uint32").when(max_token < 65536, "uint16").when(max_token < 4294967296, "uint32").otherwise("uint64")


def learning_rate(it: Column, peak: float, warmup: int = WARMUP, decay: int = DECAY, floor: float = MIN_LR, decaying: bool = True) -> Column:
    """Linear warm-up, then half a cosine from `peak` to `floor`, then `floor`; `peak` alone if not `decaying`."""
    if not decaying:
        return F.lit(peak)
    share = (it - warmup) / float(decay - warmup)
    return F.when(it < warmup, F.lit(peak) * (it + 1) / float(warmup + 1)).when(it > decay, F.lit(floor)).otherwise(F.lit(floor) + (1 + F.cos(F.pi() * share)) * ((peak - floor) / 2))


def flops_per_token(n_params: Column, layers: Column, heads: Column, width: Column, block: Column) -> Column:
    return 6 * n_params + 12 * layers * heads * F.floor(width / heads) * block


def utilisation(flops_token: Column, block: Column, passes: Column, seconds: Column) -> Column:
    """Share of the accelerator's peak reached by `passes` forward and backward passes in `seconds`."""
    return flops_token.cast("double") * block * passes / seconds / F.lit(PEAK_FLOPS)


def checkpoint_name(loss: Column, model: Column, author: Column) -> Column:
    """File name of a checkpoint: zero-padded loss, model and author without spaces ("N/A" if unknown)."""
    return F.format_string("%08.4fval_loss_%s_%s.pt", loss, model, F.replace(F.coalesce(author, F.lit("N/A")), F.lit(" "), F.lit("")))


def folder_and_file(path: Column) -> Column:
    """The two parts of a path that must have just two; raises for any other path."""
    parts = F.split(path, "/")
    return F.when(path.isNull(), None).when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not folder/file: "), path)).cast("array<string>"))


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)
