"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidelog.llm.language_model import op5_language_model
from tidelog.llm.minhash import OP4_SQL, op4_minhash
from tidelog.llm.mixing import op8_mixing
from tidelog.llm.nearest import OP3_SQL, op3_nearest
from tidelog.llm.packing import op1_packing
from tidelog.llm.sharding import op6_sharding
from tidelog.llm.token_files import op9_token_files
from tidelog.llm.toxicity import op2_toxicity
from tidelog.llm.vector_dedup import OP7_SQL, op7_vector_dedup
from tidelog.llm.warc import op10_warc


def queries() -> dict:
    own = [op1_packing, op2_toxicity, op3_nearest, op4_minhash, op5_language_model, op6_sharding, op7_vector_dedup, op8_mixing, op9_token_files, op10_warc]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_nearest": OP3_SQL, "op4_minhash": OP4_SQL, "op7_vector_dedup": OP7_SQL}
