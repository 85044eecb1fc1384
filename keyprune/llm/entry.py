"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, cws, flac, jaccard, langid, maxent, mixing, quality, suffixes, urls


def queries() -> dict:
    return {f.__name__: f for f in (bpe.op1_bpe, jaccard.op2_jaccard, suffixes.op3_suffix, quality.op4_quality, langid.op5_langid, urls.op6_urls, mixing.op7_mix, cws.op8_fingerprint, maxent.op9_lm, flac.op10_media)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": jaccard.OP2_SQL, "op3_suffix": suffixes.OP3_SQL, "op6_urls": urls.OP6_SQL, "op7_mix": mixing.OP7_SQL}
