"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from siftwell.llm.bpe import op1_bpe
from siftwell.llm.chat import OP6_SQL, op6_chat_formatting
from siftwell.llm.ngram_join import OP8_LINKS_SQL, OP8_SQL, op8_ngram_jaccard, op8_ngram_links
from siftwell.llm.packing import op9_packing
from siftwell.llm.pii import op7_pii
from siftwell.llm.quality import OP5_SQL, op5_quality
from siftwell.llm.secret_scan import op4_secret_scan
from siftwell.llm.sharding import op10_sharding
from siftwell.llm.topk import OP3_SQL, op3_topk_search
from siftwell.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_url_filter, op3_topk_search, op4_secret_scan, op5_quality, op6_chat_formatting, op7_pii, op8_ngram_jaccard, op8_ngram_links, op9_packing, op10_sharding)
}
ORACLE_SQL = {"op2_url_filter": OP2_SQL, "op3_topk_search": OP3_SQL, "op5_quality": OP5_SQL, "op6_chat_formatting": OP6_SQL, "op8_ngram_jaccard": OP8_SQL, "op8_ngram_links": OP8_LINKS_SQL}
