"""All registered queries of this subpackage."""

from faultline.llm import chat_format, curriculum, exact_dedup, license_scan, page_text, pu_quality, ranked_search, sentence_piece, shard_packing, simhash_trie, syncmers, token_count, whitening  # noqa: F401
from faultline.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
