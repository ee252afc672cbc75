"""The queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from .audio import op11_audio
from .bpe import op8_prefix_bpe
from .chat import OP9_SQL, op9_chat_format
from .collocations import OP12_SQL, op12_collocations
from .katz import op1_katz
from .mixing import op4_mixing
from .negatives import OP13_SQL, op13_hard_negatives
from .quality import OP10_SQL, op10_quality
from .simhash import op7_simhash
from .substrings import OP2_SQL, op2_substring_dedup
from .token_shards import op5_token_shards
from .topk import OP3_SQL, op3_topk
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_katz, op2_substring_dedup, op3_topk, op4_mixing, op5_token_shards, op6_toxicity, op7_simhash, op8_prefix_bpe, op9_chat_format, op10_quality, op11_audio, op12_collocations, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op3_topk": OP3_SQL, "op9_chat_format": OP9_SQL, "op10_quality": OP10_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
