"""All queries outside the optional subpackage, and the SQL each is compared with."""

from __future__ import annotations

from skarnwell.plans import base, chats, corpus, relational, reporting, retrieval  # noqa: F401 - importing registers them


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLE)
