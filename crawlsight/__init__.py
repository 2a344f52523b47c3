"""crawlsight: a PySpark-native analytics engine for crawl captures, sitemaps and URL inventories."""
