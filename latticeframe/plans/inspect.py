"""Looking at plans."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanges(df: DataFrame) -> int:
    """How many shuffles the physical plan has."""
    tree = plan_text(df).split("\n\n")[0]
    return len(re.findall(r"[-+ ]Exchange \(", tree))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df))
