"""From context specs and histories to finished prompt batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from steerframe.functions import chat as ch
from steerframe.operators.convo import Cost, render_prompt, truncate_to_budget
from steerframe.operators.sections import prompt_variants

PromptBuilder = Callable[[DataFrame, DataFrame], DataFrame]


def build_prompts(
    specs: DataFrame,
    messages: DataFrame,
    conv: str = "spec_id",
    formats: ch.Formats = ch.DEFAULT_FORMATS,
    cost: Cost = F.length,
) -> DataFrame:
    """One prompt per variant of each spec, fitted to its budget.

    Splitting contexts is narrow; the only shuffles are those of the history budget,
    and all variants of all specs go through them in one pass.
    """
    variants = prompt_variants(specs)
    fitted = truncate_to_budget(variants, messages, [conv, "batch_idx"], conv, formats, cost)
    return render_prompt(fitted, formats=formats)


def first_builder(sets: list[str], builders: dict[str, PromptBuilder]) -> PromptBuilder:
    """The prompt builder of the first chosen set that has one, else the standard one."""
    for name in sets:
        if name in builders:
            return builders[name]
    return build_prompts
