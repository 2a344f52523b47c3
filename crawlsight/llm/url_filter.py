"""URL filters by a temporal list join: every capture is judged by the list entries that were active when it was fetched.

An entry (list, scope, pattern, date, action) is valid from its date until the next one of the same list and pattern: a
validity interval whose end is the next entry's date. Captures stand in the same order, under each key that an entry could
name (the URL, the host, each parent domain), and take the entries in force at that place, an as-of join. Keys and dates
are sorted over all partitions, so that a key with a third of all rows is spread by date; a partition doesn't know what
was in force when its first key began, so rows of that key are completed by a table of one row a partition.
"""

from __future__ import annotations



import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.llm.common import map_arrow, table, written

ENTRY = 0
CAPTURE = 1
TAIL = 2
#: Specificity of a match: an exact URL, a host, then domains by their number of labels.
URL_SCOPE, HOST_SCOPE = 1000, 999
BLOCK, ALLOW, REMOVE = "block", "allow", "remove"
STATE = pa.map_(pa.string(), pa.string())
MET = pa.schema([("part", pa.int64()), ("kind", pa.int64()), ("lead", pa.bool_()), ("key", pa.string()), ("url", pa.string()), ("at", pa.int64()), ("active", STATE)])
MET_SCHEMA = "part long, kind long, lead boolean, key string, url string, at long, active map<string, string>"


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_url(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def capture_keys() -> Column:
    """Keys of the column url: u:URL, h:host, d:domain for the host and its parents of two labels at least."""
    labels = F.split(host(F.col("url")), "[.]")
    count = F.size(labels)
    suffix = lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, count - i + 1), "."))
    domains = F.when(count >= 2, F.transform(F.sequence(F.lit(1), count - 1), suffix)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("u:"), page_url(F.col("url"))), F.concat(F.lit("h:"), host(F.col("url")))), domains)


def entry_key() -> Column:
    """The key of an entry (scope url, host or domain; pattern)."""
    pattern = F.when(F.col("scope") == "url", F.concat(F.lit("u:"), page_url(F.col("pattern"))))
    pattern = pattern.when(F.col("scope") == "host", F.concat(F.lit("h:"), F.lower("pattern")))
    return pattern.when(F.col("scope") == "domain", F.concat(F.lit("d:"), F.lower("pattern")))


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def asof_partition(batches):
    """Rows (key, at, kind, list, action, url), sorted: captures with what is in force, and the partition's tail."""
    part, key, lead, state = TaskContext.get().partitionId(), None, True, {}
    for batch in batches:
        out = []
        for k, at, kind, name, action, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                lead, key, state = lead and key is None, k, {}
            if kind == ENTRY:
                state[name] = action
            elif lead or any(a != REMOVE for a in state.values()):
                out.append((part, CAPTURE, lead, k, url, at, list(state.items())))
        yield _met(out)
    if key is not None:
        yield _met([(part, TAIL, lead, key, None, None, list(state.items()))])


def _met(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(MET)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MET, strict=True)], schema=MET)


def carried(spark: SparkSession, tails: DataFrame) -> DataFrame:
    """(part, carried_key, carried): what is in force where a partition begins; a row for each, from as many rows read."""
    rows, key, state = [], None, {}
    for t in sorted(tails.select("part", "lead", "key", "active").toLocalIterator(), key=lambda r: r.part):
        rows.append((t.part, key, state))
        state = {**state, **t.active} if t.lead and t.key == key else dict(t.active)
        key = t.key
    return spark.createDataFrame(rows, "part long, carried_key string, carried map<string, string>")


def decisions(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, at, best) for each distinct (url, fetched_at) that an active entry matches."""
    spark = captures.sparkSession
    listed = entries.select(entry_key().alias("key"), micros("effective_at").alias("at"), F.lit(ENTRY).alias("kind"), F.coalesce("list_name", F.lit("")).alias("list"), "action", F.lit(None).cast("string").alias("url"))
    listed = listed.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(BLOCK, ALLOW, REMOVE))
    fetched = captures.select("url", micros("fetched_at").alias("at")).where("url IS NOT NULL AND at IS NOT NULL")
    asked = fetched.select(F.explode(capture_keys()).alias("key"), "at", F.lit(CAPTURE).alias("kind"), F.lit("").alias("list"), F.lit("").alias("action"), "url")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "at", "kind", "list", "action", "url"]
    spread = listed.unionByName(asked).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    met = written(map_arrow(spread, asof_partition, MET_SCHEMA), "url-asof")
    before = F.broadcast(carried(spark, met.where(F.col("kind") == TAIL)))
    x = met.where(F.col("kind") == CAPTURE).join(before, "part", "left")
    merged = F.map_zip_with("carried", "active", lambda _, old, new: F.coalesce(new, old))
    x = x.withColumn("active", F.when(F.col("lead") & (F.col("carried_key") == F.col("key")), merged).otherwise(F.col("active")))
    x = x.select("url", "at", "key", F.explode("active").alias("list", "action")).where(F.col("action") != REMOVE)
    scope = F.substring("key", 1, 1)
    rank = F.when(scope == "u", URL_SCOPE).when(scope == "h", HOST_SCOPE).otherwise(F.size(F.split("key", "[.]")))
    best = F.struct((-rank).alias("rank"), "action", "list", "key")
    return x.select("url", "at", best.alias("best")).groupBy("url", "at").agg(F.min("best").alias("best"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_at and any others) with decision (block, allow or none), matched_list and matched_key.

    entries: (list_name, scope, pattern, effective_at, action): scope url, host or domain (a host and all below it),
    action block, allow or remove. Of the active entries the most specific decides: URL, host, longest domain; there
    allow before block, then the first list by name. Of entries of one list, pattern and date the last action by name
    holds. Entries with another action or scope, or a null pattern or date, count for nothing; a null list is named ''.
    A null URL or time, and a URL without a match, gives none. Repeated captures stay; columns with our names are
    replaced; empty tables are fine.
    """
    ours = ("decision", "matched_list", "matched_key")
    names = [c for c in captures.columns if c not in ours]
    rows = captures.select(F.col("url"), micros("fetched_at").alias("at"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    found = written(decisions(captures, entries), "url-decisions")
    got = rows.join(found, ["url", "at"], "left")
    own = [F.coalesce("best.action", F.lit("none")), F.col("best.list"), F.col("best.key")]
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[c.alias(n) for c, n in zip(own, ours, strict=True)])


def pages_and_list(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """pages as captures fetched over the year 2024, and a list entry dated by each page, over two lists and all scopes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    after = lambda minutes: F.timestamp_micros(F.unix_micros(start) + minutes * 60_000_000)
    n = F.col("page_id")
    captures = pages.withColumn("fetched_at", after(n * 104729 % 525600))
    scope = F.element_at(F.array(F.lit("host"), F.lit("url"), F.lit("domain")), (n % 3 + 1).cast("int"))
    action = F.element_at(F.array(F.lit(REMOVE), F.lit(ALLOW), F.lit(BLOCK), F.lit(BLOCK), F.lit(BLOCK)), (n % 5 + 1).cast("int"))
    pattern = F.when(scope == "url", page_url(F.col("url"))).when(scope == "host", host(F.col("url"))).otherwise(F.substring_index(host(F.col("url")), ".", -2))
    name = F.when(n % 2 == 0, "malware").otherwise("spam")
    entries = pages.select(name.alias("list_name"), scope.alias("scope"), pattern.alias("pattern"), after(n * 7919 % 365 * 1440).alias("effective_at"), action.alias("action"))
    return captures, entries


SQL = r"""
WITH pages_ AS (
  SELECT page_id, url, regexp_replace(url, '#.*$', '') AS page,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    TIMESTAMP '2024-01-01' + to_minutes(((page_id * 104729) % 525600)::INT) AS fetched_at,
    TIMESTAMP '2024-01-01' + to_days(((page_id * 7919) % 365)::INT) AS listed_at
  FROM pages),
entries AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'malware' ELSE 'spam' END AS list,
    CASE page_id % 3 WHEN 1 THEN 'u:' || page WHEN 0 THEN 'h:' || host
      ELSE 'd:' || array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS key,
    listed_at AS dated, max(CASE page_id % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'allow' ELSE 'block' END) AS action
  FROM pages_ GROUP BY ALL),
intervals AS (
  SELECT list, key, action, dated AS valid_from, lead(dated) OVER (PARTITION BY list, key ORDER BY dated) AS valid_to FROM entries),
keys AS (
  SELECT page_id, fetched_at, 'u:' || page AS key, 1000 AS rank FROM pages_
  UNION ALL SELECT page_id, fetched_at, 'h:' || host, 999 FROM pages_
  UNION ALL SELECT page_id, fetched_at, 'd:' || array_to_string(list_slice(labels, i::INT, len(labels)::INT), '.'), len(labels) - i + 1
  FROM (SELECT page_id, fetched_at, string_split(host, '.') AS labels, unnest(range(1, len(string_split(host, '.')))) AS i FROM pages_)),
active AS (
  SELECT k.page_id, k.rank, i.action, i.list, i.key,
    row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC, i.action, i.list, i.key) AS n
  FROM keys k JOIN intervals i ON i.key = k.key AND i.valid_from <= k.fetched_at AND (i.valid_to IS NULL OR k.fetched_at < i.valid_to)
  WHERE i.action <> 'remove')
SELECT p.page_id, p.url, p.fetched_at, coalesce(a.action, 'none') AS decision, a.list AS matched_list, a.key AS matched_key
FROM pages_ p LEFT JOIN active a ON a.page_id = p.page_id AND a.n = 1
"""
