"""Registered queries of the library and the SQL that DuckDB runs beside them.

The SQL never reads a report's text: it computes the expected facts from what the text was made of (see prose)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web
from ..functions.text import fold, normalize, parse_boxer, split_sentences
from ..operators import curated, discovery, grading, pages
from ..sources import dims, parse, snapshot
from ..sources.store import kept
from . import expected, prose, report, world

QUERIES: dict = {}
SQL: dict = {}
FLAGSHIP = "match_report_fields"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _report(spark: SparkSession, sf_dir: str, *written: str) -> dict[str, DataFrame]:
    """written: the tables of facts that a query reads more than once."""
    return report.match_report(prose.fights(spark, sf_dir), prose.articles(spark, sf_dir), normalised=True, written=written)


# --- What the reports were made of, as SQL ------------------------------------------------------------------------
_BASE = f"""
p as ({prose.PARAMS}),
dom(dom, domain, name, tier, publisher) as (values {expected.DOMAINS}),
ok as (select * from p where source_id >= 2),
facts as ({expected.line_facts('ok')}),
downs as ({expected.line_knockdowns('ok')}),
src as (select p.fight_id, p.source_id, dom.* from p join dom on p.dom = dom.dom),
{expected.grading(prose.FIGHTS_SQL)}"""
_STATUS = prose.case("rank", dims.STATUSES)
_MIN_STATUS = lambda e: prose.case(e, dims.STATUSES)


def _with(select: str) -> str:
    return f"with {_BASE} {select}"


@query(_with(f"select fight_id, field, {_STATUS} as status, value, source_ids, n_values from grid"))
def match_report_fields(spark, sf_dir):
    """W-I: reports to graded fields, every fight with every field."""
    grid = _report(spark, sf_dir, "facts")["field_results"]
    return grid.select("fight_id", "field", "status", "value", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"), F.coalesce(F.size("alternatives"), F.lit(0)).cast("bigint").alias("n_values"))


@query(_with("select fight_id, source_id::int as source_id, field, value_key, display from facts"))
def page_facts(spark, sf_dir):
    return _report(spark, sf_dir)["facts"].select("fight_id", "source_id", "field", "value_key", "display")


@query(_with("select fight_id, source_id::int as source_id, victim, round::int as round, count::int as count from downs"))
def page_knockdowns(spark, sf_dir):
    return _report(spark, sf_dir)["knockdown_facts"].select("fight_id", "source_id", "victim", "round", "count")


@query(_with(f"select fight_id, victim, case victim when 'A' then 'B' else 'A' end as scorer, round::int as round, array_to_string(counts, ' / ') as count, {_STATUS} as status, array_to_string(ids, ',') as source_ids from kd"))
def knockdown_results(spark, sf_dir):
    return _report(spark, sf_dir)["knockdown_results"].withColumn("source_ids", F.array_join(F.col("source_ids").cast("array<string>"), ","))


_WM = "(select fight_id, max(case when field = 'winner' then rank end) as w, max(case when field = 'method' then rank end) as m from grid group by fight_id)"


@query(_with(f"""select fight_id, case when w = 1 then 'Not found' when w = 0 or m = 0 then 'Conflicting' when m = 1 then {_MIN_STATUS('w')} else {_MIN_STATUS('least(w, m)')} end as overall,
  case when w = 1 then 'No source stated the result of this fight.' when w = 0 or m = 0 then 'Sources disagree on the result or method — review the conflicts below.'
       when m = 1 then 'Result is ' || lower({_MIN_STATUS('w')}) || '; the method was not found.' else 'Weakest of result (' || lower({_MIN_STATUS('w')}) || ') and method (' || lower({_MIN_STATUS('m')}) || ').' end as reason from {_WM}"""))
def overall_confidence(spark, sf_dir):
    return _report(spark, sf_dir, "facts")["overall"]


@query(_with("""
, texts as (
  select fight_id, 0 as kind, pos as a, '' as b, label || ': ' || shown as text from res join fields using (field) where rank = 0
  union all select fight_id, 1, round, victim, 'Knockdowns of ' || case victim when 'A' then name_a else name_b end || ' in round ' || round || ': sources report ' || array_to_string(counts, ' vs ') || '.' from kd join (FIGHTS) f using (fight_id) where len(counts) > 1
  union all select fight_id, 2, k.round, victim, 'Knockdown reported in round ' || k.round || ', after the recorded final round ' || r.value || '.' from kd k join res r using (fight_id) where r.field = 'round' and r.rank > 0 and k.round > r.value::int
) select fight_id, string_agg(text, chr(10) order by kind, a, b, text) as conflicts from texts group by fight_id""".replace("FIGHTS", prose.FIGHTS_SQL)))
def conflict_list(spark, sf_dir):
    return _report(spark, sf_dir, "facts", "knockdown_facts")["conflicts"].select("fight_id", F.array_join("conflicts", "\n").alias("conflicts"))


@query(_with("select f.fight_id, exists (select 1 from facts x where x.fight_id = f.fight_id) as found_anything from (" + prose.FIGHTS_SQL + ") f"))
def found_anything(spark, sf_dir):
    return _report(spark, sf_dir, "facts")["found"]


@query(_with("select fight_id from (" + prose.FIGHTS_SQL + ") f where fight_id not in (select fight_id from facts) and fight_id not in (select fight_id from downs)"))
def fights_without_facts(spark, sf_dir):
    found = _report(spark, sf_dir)
    return grading.fights_without(prose.fights(spark, sf_dir), found["facts"], found["knockdown_facts"]).select("fight_id")


@query(_with(f"""select fight_id, case when r <> 1 and t <> 1 then 'Round ' || rv || ', ' || tv when r <> 1 then 'Round ' || rv else 'Not found' end as value, case when r <> 1 then {_MIN_STATUS('least(r, t)')} else 'Not found' end as status
  from (select fight_id, max(case when field = 'round' then rank end) as r, max(case when field = 'round' then value end) as rv, max(case when field = 'time' then rank end) as t, max(case when field = 'time' then value end) as tv from grid group by fight_id)"""))
def round_time_display(spark, sf_dir):
    return grading.round_time_display(_report(spark, sf_dir, "facts")["field_results"])


@query(_with("select res.fight_id, field, string_agg('[' || s.source_id || '] ' || s.name, '; ' order by s.source_id) as links from res join src s on s.fight_id = res.fight_id and list_contains(res.ids, s.source_id) group by res.fight_id, field"))
def resolved_source_links(spark, sf_dir):
    found = _report(spark, sf_dir, "facts")
    return grading.resolve_source_links(found["field_results"], found["sources"])


@query(_with("select fight_id, source_id::int as source_id, string_agg(label || ': ' || display, '; ' order by f.pos) as claims from facts f join fields using (field) where field in ('winner', 'method', 'round', 'time') group by fight_id, source_id"))
def evidence_ledger(spark, sf_dir):
    """The claims that the first sentence of each report supports."""
    facts = _report(spark, sf_dir)["facts"].where(F.col("field").isin("winner", "method", "round", "time"))
    return grading.evidence_ledger(facts).select("fight_id", "source_id", "claims")


@query(_with("select fight_id, source_id::int as source_id, case when source_id < 2 then 'preview' else 'ok' end as gate from p"))
def article_gate(spark, sf_dir):
    return pages.article_gate(prose.articles(spark, sf_dir)).select("fight_id", "source_id", "gate")


@query(_with("select fight_id, source_id::int as source_id, 'www.' || domain as host, name, tier, publisher from src"))
def attached_sources(spark, sf_dir):
    return snapshot.attach_sources(prose.articles(spark, sf_dir)).select("fight_id", "source_id", "host", "name", "tier", "publisher")


@query(_with("select fight_id, source_id::int as source_id, row_number() over (partition by fight_id order by case when source_id % 3 = 0 then 0 else 2 end, source_id)::int as n from p"))
def numbered_sources(spark, sf_dir):
    rows = prose.articles(spark, sf_dir).select("fight_id", F.when(F.col("source_id") % 3 == 0, 0).otherwise(2).alias("kind"), F.col("source_id").alias("rank"))
    return grading.number_sources(rows).select("fight_id", F.col("rank").alias("source_id"), F.col("source_id").alias("n"))


@query(_with("""
, cand as (select p.*, tier, publisher, domain, source_id as ord from p join dom using (dom) where tier in ('Official', 'Established media')),
sc as (select *, case when q % 2 = 0 then w || ' beats ' || l else sur_a || ' meets ' || sur_b end as title, abs(source_id - 3) as days from cand),
s2 as (select *, (tier <> 'Official') as unofficial, (q % 2 <> 0) as dull, -((case when contains(lower(title), lower(sur_a)) then 1 else 0 end) + (case when sur_a <> sur_b and contains(lower(title), lower(sur_b)) then 1 else 0 end)) as missed from sc),
one as (select *, row_number() over (partition by fight_id, publisher order by unofficial, dull, missed, days, ord) as pr from s2)
select fight_id, 'https://www.' || domain || '/report/' || fight_id || '/' || source_id as url, publisher, rank::int as rank
from (select *, row_number() over (partition by fight_id order by unofficial, dull, missed, days, ord) as rank from one where pr <= 2) where rank <= 8"""))
def ranked_candidates(spark, sf_dir):
    """Each report under its address and a tracking variant of it, seen later: ranked and capped."""
    a = prose.articles(spark, sf_dir)
    shape = lambda url, n: a.select("fight_id", url.alias("url"), "title", "published", F.lit("feed").alias("via"), (F.col("source_id") + n).alias("ord"), "event_name", "event_date")
    both = shape(F.concat("url", F.lit("?utm_source=feed&ref=x#top")), 100).unionByName(shape(F.col("url"), 0))
    return discovery.rank_candidates(both).select("fight_id", "url", "publisher", "rank")


_PLANS = " union all ".join(
    [f"select fight_id, {2 * i + k} as task, '{discovery.ARTICLE_SITE}' || replace({n} || '{suffix}', ' ', '_') as url from f" for i, n in enumerate(("name_a", "name_b")) for k, suffix in enumerate((" (boxer)", ""))]
    + [f"select fight_id, {4 + k}, '{site}/?s=' || sur_a || '+' || sur_b || '&feed=rss2' from f" for k, site in enumerate(dims.SEARCH_FEED_SITES)]
    + [f"select fight_id, {10 + k}, '{feed}' from f where date '{prose.TODAY}' - event_date <= 21" for k, feed in enumerate(dims.RECENT_FEEDS)]
)


@query(f"with f as (select * from ({prose.FIGHTS_SQL}) where event_date <= date '{prose.TODAY}' + 1) select fight_id, task::int as task, replace(replace(url, '(', '%28'), ')', '%29') as url from ({_PLANS})")
def discovery_plan(spark, sf_dir):
    today = F.lit(prose.TODAY).cast("date")
    return discovery.plan_discovery(discovery.validate_requests(prose.fights(spark, sf_dir), today), today).select("fight_id", "task", "url")


@query(f"select fight_id, case when event_date > date '{prose.TODAY}' + 1 then 'The event date is in the future, so no result can exist yet. Nothing was searched.' end as note from ({prose.FIGHTS_SQL})")
def validated_requests(spark, sf_dir):
    return discovery.validate_requests(prose.fights(spark, sf_dir), F.lit(prose.TODAY).cast("date")).select("fight_id", "note")


_QUOTED = "'\"' || name_a || '\" \"' || name_b || '\"'"
_EVENT = "' \"' || sur_a || ' vs ' || sur_b || '\"'"
_SEARCH = " union all ".join(f"select fight_id, {i} as pos, " + " || ".join({"pair": _QUOTED, "when": "strftime(event_date, '%d %B %Y')", "event": _EVENT}[x] if k % 2 else "'" + x + "'" for k, x in enumerate(__import__("re").split(r"[{}]", t))) + " as query from f" for i, (_, t, _) in enumerate(discovery.SEARCHES))


@query(f"with f as ({prose.FIGHTS_SQL}) select fight_id, pos::int as pos, query from ({_SEARCH})")
def search_links(spark, sf_dir):
    return discovery.source_links(prose.fights(spark, sf_dir)).select("fight_id", "pos", "query")


#: Numbers of fights that a stored part of a feed or record page spans: no document grows with the tables.
PART_SPAN = 2048


def _feeds(spark, sf_dir) -> DataFrame:
    """Feed documents for each fight's first search address, in parts by a range of fights: an item for each report; odd quantities name one boxer only, and the second line of a fight is dated too late."""
    p = prose.read(spark, sf_dir, prose.PARAMS)
    when = F.date_format(F.expr("case when source_id = 2 then date_add(event_date, 90) else date_add(event_date, source_id - 2) end"), "yyyy-MM-dd")
    title = F.when(F.col("q") % 2 == 0, F.concat("w", F.lit(" beats "), "l")).otherwise(F.concat(F.lit("Only "), "w"))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://www.espn.com/"), F.col("fight_id").cast("string"), F.lit("/"), F.col("source_id").cast("string"), F.lit("</link><description>&lt;p&gt;News&lt;/p&gt;</description><pubDate>"), when, F.lit("</pubDate></item>"))
    url = F.concat(F.lit(f"{dims.SEARCH_FEED_SITES[0]}/?s="), "sur_a", F.lit("+"), "sur_b", F.lit("&feed=rss2"))
    one = p.groupBy(url.alias("feed_url"), F.expr(f"fight_id div {PART_SPAN}").cast("string").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fight_id", "source_id", item.alias("x")))), lambda s: s["x"]), "").alias("x"))
    return one.select("feed_url", "part", F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")).alias("content"))


@query(_with("select fight_id, source_id::int as source_id, case when q % 2 = 0 then w || ' beats ' || l else 'Only ' || w end as title, 'News' as summary, strftime(case when source_id = 2 then event_date + 90 else event_date + (source_id - 2)::int end, '%Y-%m-%d') as published from p"))
def parsed_feeds(spark, sf_dir):
    items = parse.parse_feeds(_feeds(spark, sf_dir))
    part = lambda n: F.element_at(F.split("link", "/"), n)
    return items.select(part(-2).cast("bigint").alias("fight_id"), part(-1).cast("int").alias("source_id"), "title", "summary", F.date_format("published", "yyyy-MM-dd").alias("published"))


@query(_with(f"""
, asked as (select * from ({prose.FIGHTS_SQL}) where event_date <= date '{prose.TODAY}' + 1),
item as (select *, case when source_id = 2 then event_date + 90 else event_date + (source_id - 2)::int end as published from p where q % 2 = 0)
select a.fight_id, 'https://www.espn.com/' || i.fight_id || '/' || i.source_id as url from asked a join item i on a.sur_a = i.sur_a and a.sur_b = i.sur_b and i.published between a.event_date - 1 and a.event_date + 60
where case when a.sur_a = a.sur_b then (a.name_a in (i.name_a, i.name_b) and a.name_b in (i.name_a, i.name_b)) else true end"""))
def matched_feed_items(spark, sf_dir):
    today = F.lit(prose.TODAY).cast("date")
    valid = discovery.validate_requests(prose.fights(spark, sf_dir), today)
    plan = discovery.plan_discovery(valid, today).where(F.col("task") == 4)
    return discovery.match_items_to_fights(parse.parse_feeds(_feeds(spark, sf_dir)), plan, valid.where("note is null")).select("fight_id", "url")


def _record_pages(spark, sf_dir) -> DataFrame:
    """A record page for each first name and surname, in parts by a range of fights: a table row for each fight of side A, cited by a note."""
    f = prose.read(spark, sf_dir, prose.FIGHTS_SQL).withColumn("k", F.col("fight_id") % 4)
    result, kind = F.expr(prose.case("k", ["Win", "Loss", "Draw", "Win"])), F.expr(prose.case("k", ["KO", "UD", "SD", "TKO"]))
    cell = F.expr(prose.case("k", ["6 (12), 1:30", "10", "12", "3 (10)"]))
    fid = F.col("fight_id").cast("string")
    row = F.concat(F.lit("<tr><td>"), result, F.lit("</td><td>"), F.col("name_b"), F.lit("</td><td>"), kind, F.lit("</td><td>"), cell, F.lit("</td><td>"), F.date_format("event_date", "d MMM yyyy"), F.lit('</td><td>For WBA welterweight title<sup class="reference"><a href="#cite_note-'), fid, F.lit('">[1]</a></sup></td></tr>'))
    note = F.concat(F.lit('<li id="cite_note-'), fid, F.lit('"><a class="external" href="https://www.espn.com/story/'), fid, F.lit('">x</a></li>'))
    parts = F.array_sort(F.collect_list(F.struct("fight_id", row.alias("row"), note.alias("note"))))
    one = f.groupBy("name_a", F.expr(f"fight_id div {PART_SPAN}").alias("part")).agg(parts.alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda s: s[c]), "")
    html = F.concat(F.lit("<html><head><title>"), "name_a", F.lit("</title></head><body><h2 id='Professional_boxing_record'>Record</h2><table class='wikitable'><tr><th>Wins</th></tr></table><table class='wikitable'><tr><th>Result</th><th>Opponent</th><th>Type</th><th>Round, time</th><th>Date</th><th>Notes</th></tr>"), joined("row"), F.lit("</table><ol>"), joined("note"), F.lit("</ol></body></html>"))
    return one.select(F.concat(F.lit("page:"), "name_a").alias("url"), "part", html.alias("html"), "name_a")


def _record_matches(spark, sf_dir):
    parsed = kept(parse.parse_record_tables(_record_pages(spark, sf_dir)))
    sides = prose.fights(spark, sf_dir).select("fight_id", F.lit("A").alias("side"), F.concat(F.lit("page:"), "boxer_a").alias("page_url"), "event_date", F.col("b").alias("opponent"), F.col("a.full").alias("name_a"), F.col("b.full").alias("name_b"))
    return discovery.match_records_to_fights(parse.record_rows(parsed), sides), parsed, sides


_RECORD = f"""f as (select *, fight_id % 4 as k, split_part(name_b, ' ', 1) as first_b from ({prose.FIGHTS_SQL})),
rec as (select a.fight_id, a.name_a, a.name_b, r.k, r.fight_id as row_fight from f a join f r on a.name_a = r.name_a and a.sur_b = r.sur_b and abs(a.event_date - r.event_date) <= 2 qualify row_number() over (partition by a.fight_id order by r.fight_id) = 1)"""


@query(f"""with {_RECORD} select fight_id, 'winner' as field, {prose.case('k', ['A', 'B', 'Draw', 'A'])} as value_key from rec
union all select fight_id, 'method', {prose.case('k', ['KO', 'UD', 'SD', 'TKO'])} from rec union all select fight_id, 'scheduled_rounds', {prose.case('k', [12, 10, 12, 10])} from rec
union all select fight_id, 'round', case k when 0 then '6' else '3' end from rec where k in (0, 3) union all select fight_id, 'time', '1:30' from rec where k = 0
union all select fight_id, 'titles', 'WBA' from rec union all select fight_id, 'weight_class', 'Welterweight' from rec""")
def record_table_facts(spark, sf_dir):
    """W-III: record tables to facts of each fight."""
    return discovery.record_facts(_record_matches(spark, sf_dir)[0]).select("fight_id", "field", "value_key")


@query(f"with {_RECORD} select fight_id, 'https://www.espn.com/story/' || row_fight as url from rec")
def cited_candidates(spark, sf_dir):
    return discovery.cited_candidates(*_record_matches(spark, sf_dir)).select("fight_id", "url")


@query("""with t as (select doc_id, regexp_replace(coalesce(text, ''), '\\b(vs|Jr|Sr|Mr|St|No|Dr|def|Mt)\\.', '\\1', 'g') as t from documents),
s as (select doc_id, string_split(regexp_replace(t, '([.!?])\\s+([A-Z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as xs from t),
o as (select doc_id, list_filter(list_transform(xs, lambda x: trim(x)), lambda x: x <> '') as xs from s)
select doc_id, unnest(range(0, len(xs)))::int as pos, unnest(xs) as sentence from o""")
def document_sentences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(split_sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))


_NORMAL = "trim(regexp_replace(strip_accents(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query(f"select doc_id, sha256({_NORMAL}) as normal, sha256(replace(lower({_NORMAL}), 'ß', 'ss')) as folded from documents")
def normalized_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(normalize(F.col("text")).cast("binary"), 256).alias("normal"), F.sha2(fold(F.col("text")).cast("binary"), 256).alias("folded"))


@query("select page_id, replace(replace(replace(regexp_replace(url, '#.*$', ''), '?utm_source=feed', ''), '&ref=x', ''), '?ref=x', '') as canonical, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host from pages")
def canonical_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", web.canonical_url(F.col("url")).alias("canonical"), web.host_of(F.col("url")).alias("host"))


_FORMS = ["yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "d MMMM, yyyy", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'23:30:00-05:00"]


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as parsed from orders")
def parsed_dates(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    forms = F.array(*[F.date_format("o_orderdate", f) for f in _FORMS])
    return orders.select("o_orderkey", F.date_format(web.parse_date(F.get(forms, (F.col("o_orderkey") % len(_FORMS)).cast("int"))), "yyyy-MM-dd").alias("parsed"))


@query(f"select fight_id, name_a as full, split_part(name_a, ' ', 1) as first, sur_a as surname from ({prose.FIGHTS_SQL})")
def parsed_boxers(spark, sf_dir):
    suffix = F.expr(prose.case("fight_id % 4", ["", " Jr.", " III", " jr sr"]))
    return prose.fights(spark, sf_dir).select("fight_id", parse_boxer(F.concat("boxer_a", suffix)).alias("x")).select("fight_id", "x.*")


@query(f"""with c as (select fight_id as pos, event_date, lower(name_a) as a, lower(name_b) as b from ({prose.FIGHTS_SQL})),
k as (select pos, event_date, a as x, b as y from c union select pos, event_date, b, a from c)
select r.pos as request_id, min(k.pos) as pos from c r join k on r.b = k.x and r.a = k.y and (r.pos % 3 = 0 or k.event_date = r.event_date) group by r.pos""")
def curated_lookup(spark, sf_dir):
    """Every fight asked for with its names the other way round, a third without a date."""
    f = prose.fights(spark, sf_dir)
    table = f.select(F.col("fight_id").alias("pos"), F.col("boxer_a").alias("fighter_a"), F.col("boxer_b").alias("fighter_b"), "event_date", F.lit(None).cast("date").alias("offered_date"), F.array().cast("array<string>").alias("aliases"))
    asked = f.select(F.col("fight_id").alias("request_id"), F.upper("boxer_b").alias("boxer_a"), F.col("boxer_a").alias("boxer_b"), F.when(F.col("fight_id") % 3 != 0, F.col("event_date")).alias("on"))
    return curated.lookup_curated(asked, table)


@query("""select o_orderkey as pos, f as field, case f when 'Scorecards' then case when o_orderstatus = 'F' then 'Review' else 'Available' end when 'Knockdowns' then case when o_orderkey % 2 = 0 then 'Review' else 'Unavailable' end
 when 'Round statistics' then 'Unavailable' when 'Officials' then case when o_orderkey % 3 = 0 then 'Review' else 'Available' end else o_orderpriority end as status
from orders, unnest(['Outcome', 'Method', 'Round / time', 'Scorecards', 'Knockdowns', 'Round statistics', 'Officials']) as t(f)""")
def data_availability(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    table = o.select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("confidence"), F.when(F.col("o_orderstatus") == "F", "Not applicable").otherwise("117-111").alias("scorecards"), F.array(F.when(F.col("o_orderkey") % 2 == 0, "Review REPORTED").otherwise("None")).alias("knockdowns"), F.when(F.col("o_orderkey") % 3 == 0, "To be collected").otherwise("Known").alias("officials"))
    return curated.data_availability(table)


@query("""select page_id, case when page_id % 5 = 0 then 'domain not allowed' when page_id % 7 = 0 then 'HTTP 404' when page_id % 11 = 0 then 'content type' when strlen(html) * 400 > 3000000 then 'too large' else 'ok' end as outcome from pages""")
def admitted_responses(spark, sf_dir):
    k = F.col("page_id")
    r = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.when(k % 10 == 5, "https://www.espn.com.evil.net/").when(k % 5 == 0, "ftp://www.espn.com/").otherwise("https://m.espn.com/"), k.cast("string")).alias("url"), F.when(k % 7 == 0, 404).otherwise(200).alias("status"), F.when(k % 11 == 0, "application/pdf").when(k % 2 == 0, "").otherwise("text/html; charset=utf-8").alias("content_type"), (F.octet_length("html").cast("long") * 400).alias("n_bytes"))
    return snapshot.admit_responses(r).select("page_id", "outcome")


@query("""select page_id, case when n = 4 then 'https://www.espn.com/' || page_id || '/4' when n = 5 then 'https://evil.net/' || page_id when n = 6 then 'https://www.espn.com/' || page_id || '/0' else 'https://www.espn.com/' || page_id || '/' || n end as final_url,
 case when n in (4, 6) then 'redirects' when n = 5 then 'domain not allowed' end as error from (select page_id, page_id % 7 as n from pages)""")
def resolved_redirects(spark, sf_dir):
    """Chains of up to four hops, relative but for one that leaves the known domains, and circles of two."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    k, n, i = F.col("page_id"), F.col("page_id") % 7, F.col("i")
    hop = p.select("page_id", F.explode(F.sequence(F.lit(0), F.when(n == 6, 1).otherwise(F.least(n, F.lit(4))).cast("int"))).alias("i"))
    url = lambda i: F.concat(F.lit("https://www.espn.com/"), k.cast("string"), F.lit("/"), i.cast("string"))
    path = lambda i: F.concat(F.lit("/"), k.cast("string"), F.lit("/"), i.cast("string"))
    more = (i < n) | (n == 5)
    log = hop.select(url(i).alias("url"), F.when(more, 302).otherwise(200).alias("status"), F.when(n == 5, F.concat(F.lit("https://evil.net/"), k.cast("string"))).when(n == 6, path(1 - i)).when(more, path(i + 1)).alias("location"))
    wanted = p.select("page_id", url(F.lit(0)).alias("url"))
    return snapshot.resolve_redirects(log, wanted).join(wanted, "url").select("page_id", "final_url", "error")


# Made of page_id: the host, of nine, the folder, and a name that may end in .pdf.
_ROBOTS = {
    0: (404, None), 1: (403, None), 2: (500, None), 5: (None, None), 4: (200, "User-agent: *\nCrawl-delay: 60"),
    3: (200, "User-agent: *\nDisallow: /private/\nAllow: /private/public/ # but these\nDisallow: /*.pdf$"),
    6: (200, "User-agent: ResultReports\nDisallow: /open/\n\nUser-agent: *\nDisallow: /"), 7: (200, "user-agent: *\r\ndisallow: /files/\r\nallow: /files/\r\ndisallow: /private/pub*/7"), 8: (200, "User-agent: Other\nDisallow: /\n\nUser-agent: *\nDisallow:\nCrawl-delay: 5"),
}


@query("""select page_id, case page_id % 9 when 0 then 'allow' when 4 then 'slow' when 8 then 'allow' when 3 then case when d = 0 then 'deny' when d = 2 then 'allow' when page_id % 5 = 0 then 'deny' else 'allow' end
 when 6 then case when d = 1 then 'deny' else 'allow' end when 7 then case when d = 2 and cast(page_id as varchar) like '7%' then 'deny' else 'allow' end else 'deny' end as verdict from (select page_id, page_id // 9 % 4 as d from pages)""")
def robots_verdicts(spark, sf_dir):
    """Nine kinds of robots files: longest rules, stars and ends, ties, groups for one agent, hosts that can't be reached."""
    k = F.col("page_id")
    folder = F.get(F.array(*map(F.lit, ("private/", "open/", "private/public/", "files/"))), (F.expr("page_id div 9") % 4).cast("int"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("https://h"), (k % 9).cast("string"), F.lit(".net/"), folder, k.cast("string"), F.when(k % 5 == 0, ".pdf").otherwise("")).alias("url"))
    robots = spark.createDataFrame([(f"h{h}.net", status, body) for h, (status, body) in _ROBOTS.items()], "host string, status int, body string")
    return snapshot.robots_verdict(p, robots).select("page_id", "verdict")


@query()
def parsed_articles(spark, sf_dir):
    return parse.parse_articles(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("url"), "html"))


@query("select user_id as fight_id, count(*) as requests, count(*) filter (where event_type = 'click') as ok, bool_and(event_type = 'view' or event_type <> 'click') as blocked from events group by user_id")
def retrieval_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return grading.retrieval_summary(e.select(F.col("user_id").alias("fight_id"), F.when(F.col("event_type") == "view", "robots.txt").otherwise("article").alias("purpose"), F.when(F.col("event_type") == "click", "HTTP 200").otherwise("failed — HTTP 500").alias("outcome")))


@query(_with(f"""select fight_id, case when q % 3 = 0 and fight_id in (select fight_id from p where q % 3 > 0) then '{prose.CARDS}' when q % 3 = 0 then '116-112,115-113' else '{prose.CARDS}' end as value_key, count(*) as n from p group by all"""))
def merged_scorecards(spark, sf_dir):
    p = prose.read(spark, sf_dir, prose.PARAMS)
    part = F.when(F.col("q") % 3 == 0, "116-112,115-113").otherwise(prose.CARDS)
    ev = p.select("fight_id", "source_id", F.lit("scorecards").alias("field"), part.alias("value_key"), part.alias("display"), F.col("source_id").alias("ord"))
    return grading.merge_partial_scorecards(ev).groupBy("fight_id", "value_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {world.EXPECTED}, {expected.grading(world.FIGHTS)}, {world.NOTES} {world.REPORT_ROWS}")
def full_match_report(spark, sf_dir):
    """From names to graded reports over the derived crawl: fields, sources, knockdowns and notes of every bout."""
    made, fights = kept(world.lines(spark, sf_dir)), kept(world.fights(spark, sf_dir))
    crawl, feeds = kept(world.crawl(fights, made)), kept(world.feeds(made))
    return world.report_rows(report.full_match_report(fights, crawl, feeds, world.robots(spark), F.lit(world.TODAY).cast("date")))
