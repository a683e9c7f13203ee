"""DataFrame-to-DataFrame steps: pages, sites, leads, search hits, responses."""
