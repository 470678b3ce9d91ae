"""Operators for preparing book text as language-model training data.

Nothing outside this subpackage imports it.  ``queries`` and ``oracles`` are
what the repository's entry module registers when the subpackage is present.
"""

from __future__ import annotations


def queries():
    from bookloom.llm import registry

    return registry.queries()


def oracles():
    from bookloom.llm import registry

    return registry.oracles()
