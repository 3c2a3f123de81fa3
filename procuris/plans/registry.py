"""All queries by name: QUERIES holds the Spark form, SQL the same query as text."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL form if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


from procuris.plans import cards, delivery, extracts, features, feeds, files, matching, models, reports, served, spend  # noqa: E402, F401  they register themselves
