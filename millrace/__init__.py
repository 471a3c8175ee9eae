"""Spark-first building blocks for trustworthy warehouse data: star schemas, audited cleaning, changing dimensions and the queries over them."""
