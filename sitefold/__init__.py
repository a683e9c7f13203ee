"""Company records from tables of crawled web pages, as Spark DataFrame jobs."""
