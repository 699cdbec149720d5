"""Registered queries of this package: opN_<name> -> (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from trawlmill.llm.op1_bpe import op1_byte_bpe
from trawlmill.llm.op10_quality import op10_quality_cotraining
from trawlmill.llm.op11_repair import op11_conversation_repair
from trawlmill.llm.op12_merkle import OP12_SQL, op12_merkle_manifest
from trawlmill.llm.op13_pieces import op13_sentencepiece
from trawlmill.llm.op2_suffix_dedup import op2_suffix_dedup
from trawlmill.llm.op3_near_dedup import op3_minhash_near_dedup
from trawlmill.llm.op4_order_minhash import op4_order_minhash
from trawlmill.llm.op5_katz import op5_katz_backoff
from trawlmill.llm.op6_language import op6_language_id
from trawlmill.llm.op7_token_counts import op7_token_counts
from trawlmill.llm.op8_warc import op8_warc_derivatives
from trawlmill.llm.op9_decontaminate import OP9_SQL, op9_benchmark_decontamination

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_order_minhash": op4_order_minhash,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_cotraining": op10_quality_cotraining,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE: dict[str, str] = {
    "op9_benchmark_decontamination": OP9_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
