"""All queries of the library proper with the SQL that says the same."""

from plazamill.plans import aggregates, base, catalog, endpoints, extras, jsonld, labels, listing, more, page_rules, pages, policy, portals, scalars, sections, sites, state, texts, whole_endpoints  # noqa: F401  (they register)

QUERIES = base.QUERIES
SQL = base.SQL
