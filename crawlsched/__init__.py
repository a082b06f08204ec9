"""crawlsched: crawl scheduling and corpus analytics on PySpark.

The crawl state is a set of tables (urls, queues, leases, settings); every operation is a DataFrame plan.
"""

__version__ = "0.1.0"
