"""The catalogs of the core queries."""

from watchgrid import catalog, catalog_live, catalog_more, catalog_places, catalog_reports, catalog_state, catalog_stream, catalog_text, catalog_walks

ALL = [catalog, catalog_state, catalog_text, catalog_live, catalog_places, catalog_reports, catalog_stream, catalog_more, catalog_walks]
