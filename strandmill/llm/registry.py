"""The queries of the training-data operators, and SQL for those that SQL can express."""

from strandmill.llm import bpe_tree, exact_dedup, hard_negatives, language_id, media, metric_tree, mixing, quality, secrets, simhash, token_output, warc_audit, whitening

MODULES = (mixing, token_output, simhash, media, exact_dedup, language_id, warc_audit, bpe_tree, quality, secrets, hard_negatives, metric_tree, whitening)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
