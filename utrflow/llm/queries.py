"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from utrflow.llm import curves, exact_dedup, licenses, ngram_join, packing, periodic, pii, piece_codec, quality, quotes, spelling, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_warc": warc.op4_warc,
    "op5_quotes": quotes.op5_quotes,
    "op6_pii": pii.op6_pii,
    "op7_licenses": licenses.op7_licenses,
    "op8_curves": curves.op8_curves,
    "op9_packing": packing.op9_packing,
    "op10_piece_codec": piece_codec.op10_piece_codec,
    "op11_quality": quality.op11_quality,
    "op12_periodic": periodic.op12_periodic,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_quotes": quotes.OP5_SQL,
    "op6_pii": pii.OP6_SQL,
    "op7_licenses": licenses.OP7_SQL,
}
