"""Queries and SQL of this package, for the driver's entry module."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, near_dedup, packing, quality, secret_scan, sstable, topk_search, warc_archive

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_token_shards": sstable.op3_token_shards,
    "op4_packing": packing.op4_packing,
    "op5_warc_archive": warc_archive.op5_warc_archive,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_quality": quality.op7_quality,
    "op8_language_id": language_id.op8_language_id,
    "op8_language_id_pages": language_id.op8_language_id_pages,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}
ORACLE_SQL = {
    "op1_topk_search": topk_search.SQL,
    "op5_warc_archive": warc_archive.SQL,
}
