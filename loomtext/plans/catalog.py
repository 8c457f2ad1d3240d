"""The registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from loomtext.plans import language, meaning, models, structures, tokens

CATALOG = {**tokens.CATALOG, **models.CATALOG, **structures.CATALOG, **language.CATALOG, **meaning.CATALOG}
