"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from tarja.llm.chat import OP9_SQL, op9_chat_formatting
from tarja.llm.decontaminate import op3_decontamination
from tarja.llm.fingerprint import op10_fingerprints
from tarja.llm.langid import op6_language_id
from tarja.llm.minhash import op1_minhash_dedup
from tarja.llm.packing import op2_packing
from tarja.llm.recompress import op8_substring_dedup
from tarja.llm.suffix_dedup import op4_suffix_array_dedup
from tarja.llm.token_ids import op5_token_ids
from tarja.llm.toxicity import op7_toxicity

_QUERIES = [op1_minhash_dedup, op2_packing, op3_decontamination, op4_suffix_array_dedup, op5_token_ids, op6_language_id, op7_toxicity, op8_substring_dedup, op9_chat_formatting, op10_fingerprints]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_formatting": OP9_SQL}
