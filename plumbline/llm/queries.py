"""The registered queries of this package and, where SQL can state them, their SQL."""

from plumbline.llm import audit, bpe, chat, ctw, exact_dedup, fingerprint, language, licenses, mixing, neardup, quality, repair, vectors

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_bpe": bpe.op4_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_chat": chat.op6_chat,
    "op7_neardup": neardup.op7_neardup,
    "op8_licenses": licenses.op8_licenses,
    "op9_ctw": ctw.op9_ctw,
    "op10_language": language.op10_language,
    "op11_repair": repair.op11_repair,
    "op12_vectors": vectors.op12_vectors,
    "op13_audit": audit.op13_audit,
}
ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op8_licenses": licenses.OP8_SQL,
    "op12_vectors": vectors.OP12_SQL,
    "op13_audit": audit.OP13_SQL,
}
