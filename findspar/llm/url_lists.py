"""URL filters: a temporal join of captures with dated list entries, in DataFrame functions only.

A list is a log of dated entries: (domain, day, action, category), action `add` or
`remove`.  Per domain and category the next entry ends an `add`, which turns the
log into validity intervals [from, to).  A capture is evaluated against the
entries active on the day it was fetched: its host and all parent domains are
looked up by an as-of join (equal domain, from <= fetched < to), and the most
specific active domain decides.

Captures are first reduced to distinct (host, day), so a host with a third of
all captures enters the join at most once a day; decisions are joined back by host
and day, where adaptive execution can split a common pair.  Nothing is broadcast
by hint and no key's rows are ever gathered.

Defined results: null or unparsable urls have a null host and aren't blocked;
neither are captures without a day; repeated entries count once; entries with
a null domain or day are ignored; of entries of one day a removal comes last; ties between
categories of one domain go to the category that sorts first.  Every capture row
gives one result row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findspar.llm._frames import narrow

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: str) -> F.Column:
    """The url's host in lower case, without a final dot; null if it has none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def suffixes(host: str) -> F.Column:
    """The host and its parent domains down to two labels (a host of one label: itself)."""
    labels = F.split(host, r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, category, valid_from, valid_to) from (domain, day, action, category); an open interval has a null valid_to."""
    clean = entries.where("domain is not null and day is not null").select(F.lower("domain").alias("domain"), "day", "action", F.coalesce("category", F.lit("")).alias("category")).distinct()
    order = Window.partitionBy("domain", "category").orderBy("day", "action")
    spans = clean.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'")
    return spans.where("valid_to is null or valid_to > day").select("domain", "category", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, capture_id: str, url: str, fetched: str) -> DataFrame:
    """capture_id, host, fetched_on, blocked, matched_domain, category, active_since of every capture row."""
    rows = narrow(captures, capture_id=capture_id, url=url, fetched_on=fetched).withColumn("host", host_of("url"))
    keys = rows.select("host", "fetched_on").where("host is not null and fetched_on is not null").distinct()
    asked = keys.withColumn("domain", F.explode(suffixes("host")))
    active = intervals(entries)
    hits = asked.join(active, (asked["domain"] == active["domain"]) & (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    best = F.min(F.struct((-F.length(asked["domain"])).alias("specific"), asked["domain"].alias("domain"), F.col("category"), F.col("valid_from"))).alias("best")
    decided = hits.groupBy("host", "fetched_on").agg(best).select(F.col("host").alias("d_host"), F.col("fetched_on").alias("d_day"), "best")
    joined = rows.join(decided, (F.col("host") == F.col("d_host")) & (F.col("fetched_on") == F.col("d_day")), "left")
    return joined.select("capture_id", "host", "fetched_on", F.col("best").isNotNull().alias("blocked"), F.col("best.domain").alias("matched_domain"), F.col("best.category").alias("category"), F.col("best.valid_from").alias("active_since"))


def _number(column: str) -> F.Column:
    return F.conv(F.substring(F.md5(F.col(column).cast("binary")), 1, 8), 16, 10).cast("bigint")


def derived_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """A stand-in for a dated list, since the data hold none: by a hash, a quarter of all domains of the pages are added, most are removed later, some are added again."""
    domains = narrow(pages, url=url).select(host_of("url").alias("host")).where("host is not null").distinct().select(F.explode(suffixes("host")).alias("domain")).distinct()
    listed = domains.withColumn("h", _number("domain")).where("h % 4 = 0").withColumn("category", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.col("h") % 3 + 1).cast("int")))
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 300).cast("int"))
    def entry(day: F.Column, action: str, on: F.Column) -> F.Column:
        return F.struct(day.alias("day"), F.lit(action).alias("action"), on.alias("on"))

    log = F.array(
        entry(start, "add", F.col("h") >= 0),
        entry(F.date_add(start, (F.col("h") % 97 + 20).cast("int")), "remove", F.col("h") % 5 > 0),
        entry(F.date_add(start, (F.col("h") % 89 + 150).cast("int")), "add", F.col("h") % 7 == 0),
    )
    return listed.select("domain", "category", F.explode(F.filter(log, lambda x: x["on"])).alias("e")).select("domain", "e.day", "e.action", "category")


def digest(pages: DataFrame) -> DataFrame:
    """page_id and the decision for each page, fetched on a day of 2024 that its id gives."""
    captures = narrow(pages, page_id="page_id", url="url").withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")))
    decided = evaluate(captures, derived_list(pages), "page_id", "url", "fetched_on")
    return decided.select(F.col("capture_id").alias("page_id"), "host", F.col("fetched_on").cast("string").alias("fetched_on"), "blocked", "matched_domain", "category", F.col("active_since").cast("string").alias("active_since"))


SQL = r"""
WITH c AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
         DATE '2024-01-01' + ((page_id * 37 % 366 + 366) % 366)::INTEGER AS fetched_on
  FROM pages
), x AS (
  SELECT host, unnest(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.'))) AS domain
  FROM (SELECT DISTINCT host, string_split(host, '.') AS l FROM c WHERE host IS NOT NULL)
), h AS (
  SELECT domain, ('0x' || substr(md5(domain), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT domain FROM x)
), s AS (
  SELECT domain, h, ['adult', 'malware', 'spam'][h % 3 + 1] AS category, DATE '2024-01-01' + (h % 300)::INTEGER AS start FROM h WHERE h % 4 = 0
), e AS (
  SELECT domain, category, start AS day, 'add' AS action FROM s
  UNION ALL SELECT domain, category, start + (h % 97 + 20)::INTEGER, 'remove' FROM s WHERE h % 5 > 0
  UNION ALL SELECT domain, category, start + (h % 89 + 150)::INTEGER, 'add' FROM s WHERE h % 7 = 0
), v AS (
  SELECT domain, category, action, day AS valid_from, lead(day) OVER (PARTITION BY domain, category ORDER BY day, action) AS valid_to FROM e
), m AS (
  SELECT c.page_id, c.host, c.fetched_on, x.domain, v.category, v.valid_from,
         row_number() OVER (PARTITION BY c.host, c.fetched_on, c.page_id ORDER BY length(x.domain) DESC, x.domain, v.category) AS rank
  FROM c JOIN x ON c.host = x.host JOIN v ON v.domain = x.domain AND v.action = 'add' AND c.fetched_on >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_on < v.valid_to)
)
SELECT c.page_id, c.host, c.fetched_on::VARCHAR AS fetched_on, m.domain IS NOT NULL AS blocked, m.domain AS matched_domain, m.category, m.valid_from::VARCHAR AS active_since
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.rank = 1
"""
