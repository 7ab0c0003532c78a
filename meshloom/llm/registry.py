"""All queries of this subpackage and their SQL."""

from . import audit, chat, decontaminate, langid, linededup, neardup, packing, pii, quality, resample, token_files, urls, warc

_MODULES = (neardup, token_files, packing, langid, chat, quality, decontaminate, warc, pii, urls, resample, audit, linededup)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
