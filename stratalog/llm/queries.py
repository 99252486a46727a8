"""Queries of this package: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from stratalog.llm import exact_dedup, near_dedup, substring_dedup, topk, url_filter, warc
from stratalog.llm.byte_bpe import op1_byte_bpe
from stratalog.llm.exact_dedup import op3_exact_dedup
from stratalog.llm.near_dedup import op6_near_dedup
from stratalog.llm.pack_docs import op2_packing
from stratalog.llm.secrets import op5_secrets
from stratalog.llm.topk import op4_topk
from stratalog.llm.substring_dedup import op10_substring_dedup
from stratalog.llm.toxicity import op9_toxicity
from stratalog.llm.url_filter import op8_url_filter
from stratalog.llm.warc import op7_warc

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_packing, op3_exact_dedup, op4_topk, op5_secrets, op6_near_dedup, op7_warc, op8_url_filter, op9_toxicity, op10_substring_dedup)}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_topk": topk.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}
