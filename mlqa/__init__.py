"""mlqa: multilingual factual-QA data work as Spark DataFrame operators.

Sub-packages
------------
sources    readers, writers, schema checks and the fixture views used by tests
functions  Column -> Column helpers (text, tags, scripts, similarity, prompt text)
operators  DataFrame -> DataFrame operators (corpus build, rewards, language id,
           judging, evaluation aggregates)
plans      plan-shaping helpers: session, global numbering without a single task,
           lineage cuts
streaming  Structured Streaming roll-ups of step metrics
"""

from mlqa.session import get_spark  # noqa: F401
