"""The stored crawl: pages, responses, redirects and robots files."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.web import host_of, host_suffixes, part
from . import dims
from .parse import absolute
from .store import kept, salted

PAGES = "url string, final_url string, status int, content_type string, html string, error string"
# Types that count as readable, sizes and limits of a polite crawl.
ACCEPTED = ["text/html", "application/xhtml", "application/rss", "application/atom", "application/xml", "text/xml"]
MOST_BYTES, MOST_HOPS, MOST_DELAY, MOST_ROBOTS = 3_000_000, 3, 10, 500_000
AGENT = "ResultReports"
REDIRECTS = [301, 302, 303, 307, 308]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def domain_at(host: Column) -> Column:
    """The place in the table of the first domain that a host is or lies under, or null. The table is a literal: no join."""
    places = F.create_map(*[F.lit(x) for i, (d, _, _) in enumerate(dims.DOMAINS) for x in (d, i)])
    return F.array_min(F.transform(host_suffixes(host), lambda s: F.try_element_at(places, s)))


def attach_sources(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, domain, name, tier, publisher."""
    out = df.withColumn("host", host_of(F.col(url))).withColumn("_at", domain_at(F.col("host")))
    of = lambda k: F.get(F.array(*[F.lit(d[k]) for d in dims.DOMAINS]), F.col("_at"))
    aliases = F.create_map(*[F.lit(x) for kv in dims.PUBLISHER_ALIASES.items() for x in kv])
    out = out.withColumns({"domain": of(0), "name": F.coalesce(of(1), "host"), "tier": F.coalesce(of(2), F.lit("Other"))})
    domain = F.coalesce("domain", "host")
    return out.withColumn("publisher", F.coalesce(F.try_element_at(aliases, domain), domain)).drop("_at")


def allowed(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds is_allowed: an http address of a known domain or feed host."""
    out = attach_sources(df, url)
    return out.withColumn("is_allowed", F.lower(part(F.col(url), 1)).isin("http", "https") & (F.col("domain").isNotNull() | F.col("host").isin(dims.FEED_ONLY_HOSTS)))


def admit_responses(responses: DataFrame, url: str = "url") -> DataFrame:
    """Adds outcome: the first rule that a response fails, or ok. responses: url, status, content_type, n_bytes."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    readable = kind == ""
    for prefix in ACCEPTED:
        readable |= F.startswith(kind, F.lit(prefix))
    out = allowed(responses, url)
    outcome = (
        F.when(~F.coalesce("is_allowed", F.lit(False)), "domain not allowed")
        .when(F.coalesce("status", F.lit(0)) != 200, F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
        .when(~readable, "content type").when(F.col("n_bytes") > MOST_BYTES, "too large").otherwise("ok")
    )
    return out.withColumn("outcome", outcome).select(*responses.columns, "outcome")


def resolve_redirects(log: DataFrame, wanted: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """url, final_url, status, error: each wanted address followed through at most three redirects; the domain, and the robots rules (as robots_rules gives) if there are any, are checked at every hop. log: url, status, location.

    Only addresses that still move are joined on the next hop; what has come to its end is set aside, and the loop ends when
    nothing moves. An address that comes back to itself moves until the hops are used up. A missing log row of a repeated
    address is of no matter: the first of its rows counts."""
    steps = log.groupBy(F.col("url").alias("at")).agg(F.min(F.struct(F.col("status").alias("got"), "location")).alias("_r")).select("at", "_r.got", "_r.location")
    moving, settled = kept(wanted.select("url").where("url is not null").distinct().withColumn("at", F.col("url"))), []
    for _ in range(MOST_HOPS + 1):
        checked = allowed(moving, "at").select("url", "at", "is_allowed")
        if rules is not None:
            # A blocked domain needs no verdict.
            checked = checked.join(verdicts(checked.where("is_allowed").select(F.col("at").alias("url")), rules).withColumnRenamed("url", "at"), "at", "left")
        else:
            checked = checked.withColumn("verdict", F.lit("allow"))
        met = checked.join(steps, "at", "left")
        moves = F.col("got").isin(REDIRECTS) & (F.coalesce("location", F.lit("")) != "")
        stopped = F.when(~F.coalesce("is_allowed", F.lit(False)), "domain not allowed").when(F.coalesce("verdict", F.lit("deny")) == "deny", "robots").when(F.col("verdict") == "slow", "crawl-delay").when(F.col("got").isNull(), "not crawled")
        met = met.withColumns({"stopped": stopped, "moves": stopped.isNull() & moves})
        next_at = F.when(F.col("moves"), absolute("at", "location"))
        met = kept(met.select("url", "at", "got", "stopped", "moves", next_at.alias("next")))
        error = F.when(F.col("stopped").isNotNull(), F.col("stopped")).when(F.col("got") != 200, F.concat(F.lit("HTTP "), F.col("got").cast("string")))
        settled.append(met.where("not moves").select("url", F.col("at").alias("final_url"), F.when(F.col("stopped").isNull(), F.col("got")).alias("status"), error.alias("error")))
        moving = met.where("moves").select("url", F.col("next").alias("at"))
        if moving.isEmpty():
            break
    else:
        settled.append(moving.select("url", F.col("at").alias("final_url"), F.lit(None).cast("int").alias("status"), F.lit("redirects").alias("error")))
    return reduce(DataFrame.unionByName, settled)


def robots_rules(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """host, segment, pattern, length, verdict: the rules of each host for an agent, as rows. robots: host, status (null: unreachable), body.

    The rules are those of the groups that name the agent, else of the groups for all. A pattern may hold stars and end in a
    dollar sign. Segment is the first part of the path, if the pattern spells it wholly, else empty. What holds for a whole
    host is a rule of its own: of length -1 if all may be read, of the greatest length if nothing may, or a delay is too long."""
    one = robots.groupBy("host").agg(F.min(F.struct("status", "body")).alias("_r")).select("host", "_r.status", "_r.body")
    readable = F.coalesce(F.col("status").between(200, 399), F.lit(False))
    line = F.btrim(F.regexp_replace("line", r"#.*$", ""))
    lines = one.where(readable).select("host", F.posexplode(F.split(F.substring(F.coalesce("body", F.lit("")), 1, MOST_ROBOTS), "\r\n|\r|\n")).alias("pos", "line"))
    lines = lines.select("host", "pos", F.lower(F.btrim(F.substring_index(line, ":", 1))).alias("key"), F.btrim(F.regexp_replace(line, "^[^:]*:?", "")).alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    own = Window.partitionBy("host").orderBy("pos")  # a file is bounded
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(own), F.lit("")) != "user-agent")
    lines = lines.withColumn("group", F.sum(F.when(starts, 1).otherwise(0)).over(own))
    name = F.lower(F.substring_index("value", "/", 1))
    groups = Window.partitionBy("host", "group")
    named = F.bool_or((F.col("key") == "user-agent") & (name != "*") & (name != "") & F.contains(F.lit(agent.lower()), name)).over(groups)
    lines = lines.withColumns({"named": named, "general": F.bool_or((F.col("key") == "user-agent") & (name == "*")).over(groups)})
    lines = lines.withColumn("any_named", F.bool_or("named").over(Window.partitionBy("host"))).where(F.when(F.col("any_named"), F.col("named")).otherwise(F.col("general")))
    rules = lines.where(F.col("key").isin("allow", "disallow") & (F.col("value") != ""))
    spelled = F.regexp_extract("value", r"^/([^/*$?]+)/", 1)
    rules = rules.select("host", spelled.alias("segment"), F.col("value").alias("pattern"), F.char_length("value").alias("length"), F.when(F.col("key") == "allow", "allow").otherwise("deny").alias("verdict"))
    delay = lines.where(F.col("key") == "crawl-delay").groupBy("host").agg(F.max(F.col("value").try_cast("int")).alias("delay")).where(F.col("delay") > MOST_DELAY)
    status = F.col("status")
    whole = F.when(status.isNull() | status.isin(401, 403) | (status >= 500), "deny").when(status >= 400, "allow").when(F.col("delay").isNotNull(), "slow").otherwise("allow")
    hosts = one.join(delay, "host", "left").select("host", F.lit("").alias("segment"), F.lit("").alias("pattern"), F.when(whole == "allow", -1).otherwise(1 << 30).alias("length"), whole.alias("verdict"))
    return rules.unionByName(hosts)


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, verdict: a row for each address that a rule matches. urls: url; rules: a written table, as robots_rules gives.

    Each address meets the rules of its host that spell its first segment, and those that spell none; of those that match the
    longest decides, and of equally long ones an allowing one. Hosts with very many addresses are salted."""
    rest = F.concat(part(F.col("url"), 3), F.when(part(F.col("url"), 4) != "", F.concat(F.lit("?"), part(F.col("url"), 4))).otherwise(F.lit("")))
    urls = kept(urls.select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": F.when(rest == "", "/").otherwise(rest)}))
    segment = F.regexp_extract("path", "^/([^/?]+)/", 1)
    asked = urls.withColumn("segment", F.explode(F.array_distinct(F.array(F.lit(""), segment))))
    left, right, on = salted(asked, rules, ["host", "segment"], F.col("url"))
    pattern = F.col("pattern")
    body = F.regexp_replace(pattern, r"\$$", "")
    regex = F.concat(F.lit("^"), F.replace(F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1"), F.lit("*"), F.lit(".*")), F.when(F.endswith(pattern, F.lit("$")), F.lit("$")).otherwise(F.lit("")))
    plain = ~F.contains(pattern, F.lit("*")) & ~F.endswith(pattern, F.lit("$"))
    fits = F.when(plain, F.startswith("path", pattern)).otherwise(F.regexp_like("path", regex))
    allow_first = F.when(F.col("verdict") == "allow", 1).otherwise(0)
    return left.join(right, on).where(fits).groupBy("url").agg(F.max(F.struct("length", allow_first.alias("a"), "verdict"))["verdict"].alias("verdict"))


def robots_verdict(pages: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """pages and verdict: allow, deny or slow. pages: url; robots: host, status, body. A host without a robots row was not reached: deny."""
    found = verdicts(pages, kept(robots_rules(robots, agent)))
    return pages.join(found, "url", "left").withColumn("verdict", F.coalesce("verdict", F.lit("deny"))).select(*pages.columns, "verdict")


def fetched(wanted: DataFrame, crawl: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """url, final_url, outcome of each wanted address: how a polite crawl comes to it, `ok` if its final response may be read.

    crawl: url, status, location, content_type, n_bytes: a row for each stored response."""
    ends = resolve_redirects(crawl.select("url", "status", "location"), wanted, rules)
    one = crawl.groupBy("url").agg(F.min(F.struct("status", "content_type", "n_bytes")).alias("_r")).select(F.col("url").alias("final_url"), "_r.*")
    good = ends.where("error is null").select("url", "final_url").join(one, "final_url")
    admitted = admit_responses(good.select("url", "final_url", "status", "content_type", "n_bytes"), "final_url").select("url", "final_url", "outcome")
    return admitted.unionByName(ends.where("error is not null").select("url", "final_url", F.col("error").alias("outcome")))
