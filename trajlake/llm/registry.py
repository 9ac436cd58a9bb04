"""The subpackage's registered queries and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from trajlake.llm.class_lm import op7_class_lm
from trajlake.llm.collocations import OP13_SQL, op13_collocations
from trajlake.llm.decontaminate import op8_decontaminate
from trajlake.llm.imatch import op10_imatch
from trajlake.llm.importance import op6_importance
from trajlake.llm.language import op11_language
from trajlake.llm.merkle import OP12_SQL, op12_merkle
from trajlake.llm.minhash_dedup import op4_minhash_dedup
from trajlake.llm.mixing import op3_mix_sources
from trajlake.llm.reshard import op1_reshard
from trajlake.llm.substring_dedup import op2_substring_dedup
from trajlake.llm.url_lists import OP9_SQL, op9_url_lists
from trajlake.llm.warc import OP5_SQL, op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_reshard": op1_reshard,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_warc": op5_warc,
    "op6_importance": op6_importance,
    "op7_class_lm": op7_class_lm,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_lists": op9_url_lists,
    "op10_imatch": op10_imatch,
    "op11_language": op11_language,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op5_warc": OP5_SQL,
    "op9_url_lists": OP9_SQL,
    "op12_merkle": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
