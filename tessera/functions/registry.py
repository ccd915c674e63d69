"""Named operators with their options and defaults, for pipelines built from plain data."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import color, geometry, loops, pixels, segment


def _options(fn: Callable) -> dict[str, object]:
    return {k: p.default for k, p in inspect.signature(fn).parameters.items() if p.default is not inspect.Parameter.empty}


#: Operators from one table to one table, by name, with their options' defaults.
OPERATORS: dict[str, tuple[Callable, dict[str, object]]] = {
    f.__name__: (f, _options(f))
    for f in (
        pixels.recolor, pixels.orient, pixels.densify, color.frame_stats, color.border_color, color.dominant_color, segment.outline, segment.glow, segment.gaussian_blur, geometry.resize, geometry.pad, geometry.trim,
        geometry.retime_drop, geometry.retime_repeat, geometry.retime_interpolate, loops.pingpong, loops.reverse_loop, loops.hold_loop, loops.fade_loop, loops.blend_loop, loops.speedramp, loops.morph_loop, loops.make_loop,
    )
}


def run(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """The named steps in order; an unknown name or option stops before anything runs."""
    plan = []
    for name, options in steps:
        if name not in OPERATORS:
            raise ValueError(f"unknown operator: {name}")
        fn = OPERATORS[name][0]
        inspect.signature(fn).bind(None, **options)
        plan.append((fn, options))
    return geometry.pipeline(df, plan)
