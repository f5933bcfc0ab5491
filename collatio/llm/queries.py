"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontam, jaccard, langid, licenses, packing, quality, sharding, substrings, urls, warc

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.joined_documents,
    "op2_packing": packing.packed_documents,
    "op3_sharding": sharding.sharded_documents,
    "op4_language_id": langid.identified_documents,
    "op5_url_filters": urls.judged_pages,
    "op6_warc": warc.archived_pages,
    "op7_quality_rules": quality.judged_documents,
    "op8_benchmark_decontamination": decontam.contaminated_documents,
    "op9_license_scans": licenses.scanned_documents,
    "op10_substring_dedup": substrings.deduplicated_documents,
}

SQL = {
    "op1_ngram_jaccard_join": jaccard.JOINED_SQL,
    "op6_warc": warc.ARCHIVED_SQL,
    "op8_benchmark_decontamination": decontam.CONTAMINATED_SQL,
    "op9_license_scans": licenses.SCANNED_SQL,
    "op10_substring_dedup": substrings.DEDUPLICATED_SQL,
}
