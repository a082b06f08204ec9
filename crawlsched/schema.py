"""Schemas of the crawl state and of what goes in and out. All times are epoch seconds."""

METADATA = "map<string,array<string>>"
KEYS = ["crawl_id", "key"]
URL_KEYS = ["crawl_id", "key", "url"]

PUTS = f"seq bigint, id string, kind string, crawl_id string, key string, url string, metadata {METADATA}, refetch bigint"
BATCHES = f"seq bigint, id string, items array<struct<url:string,key:string,crawl_id:string,metadata:{METADATA}>>"
ACKS = "seq bigint, id string, kind string, status string"
URLS = f"crawl_id string, key string, url string, metadata {METADATA}, refetch bigint, creation_date bigint"
QUEUES = "crawl_id string, key string, blocked_until bigint, delay bigint, last_produced bigint, crawl_limit bigint, rotation_pos bigint"
LEASES = "crawl_id string, key string, url string, held_until bigint"

DEFAULT_CRAWL = "DEFAULT"
DEFAULT_DELAY = 1
DEFAULT_LEASE = 30
DEFAULT_PAGE = 100
LONGEST_KEY = 255
#: Delay of a queue that follows the default of the service, and blocked_until of a queue that was never blocked.
UNSET = -1


def columns(ddl: str) -> list[str]:
    """Top-level column names of one of the schemas above."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names
