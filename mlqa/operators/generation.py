"""Generation rows (D12): repaired text, parsed blocks and the model name."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlqa.functions.text import extract_tag_or_empty, repair_tags


def model_name(base_model: str, lora_path: str | None = None) -> str:
    """``base`` or ``base_lora_<basename of the adapter path>``."""
    return base_model if not lora_path else f"{base_model}_lora_{posixpath.basename(lora_path)}"


def generation_rows(df: DataFrame, text_col: str, base_model: str,
                    lora_path: str | None = None) -> DataFrame:
    """Attach ``llm_generation`` (tags repaired), ``model_name``,
    ``extracted_reasoning`` and ``extracted_answer`` ('' when a block is absent)."""
    g = repair_tags(text_col)
    return (df.withColumn("llm_generation", g)
            .withColumn("model_name", F.lit(model_name(base_model, lora_path)))
            .withColumn("extracted_reasoning", extract_tag_or_empty("llm_generation", "think"))
            .withColumn("extracted_answer", extract_tag_or_empty("llm_generation", "answer")))
