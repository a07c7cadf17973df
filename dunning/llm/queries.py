"""Queries of the corpus operators, by name."""

from __future__ import annotations

from .centroids import op11_centroids
from .decontaminate import op6_decontaminate
from .exact_dedup import op10_exact_dedup
from .licenses import op9_license_scan
from .merkle import op12_merkle
from .passages import op7_passages
from .pii import op1_pii
from .quality import op3_quality
from .sentencepieces import op5_sentencepiece
from .simhash import op2_simhash
from .suffixes import op13_repeats
from .tokenfiles import op4_token_files
from .warc import op8_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_simhash,
        op3_quality,
        op4_token_files,
        op5_sentencepiece,
        op6_decontaminate,
        op7_passages,
        op8_warc,
        op9_license_scan,
        op10_exact_dedup,
        op11_centroids,
        op12_merkle,
        op13_repeats,
    )
}
