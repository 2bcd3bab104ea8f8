"""pagesift: Spark jobs that pull structured data out of tables of captured pages."""
