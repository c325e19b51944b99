"""SQL of the other engine for what reports must hold: the facts that a line's text states, and how they are graded."""
from __future__ import annotations

from ..sources import dims
from .prose import CARDS, METHOD_KEYS, case

DOMAINS = ", ".join(f"({i}, '{d}', '{n}', '{t}', '{dims.PUBLISHER_ALIASES.get(d, d)}')" for i, (d, n, t) in enumerate(dims.DOMAINS))
_FIELD_ROWS = ", ".join(f"('{f}', '{label}', {i}, {str(m).lower()})" for i, (f, label, m) in enumerate(dims.FIELDS))


def line_facts(ok: str) -> str:
    """The facts of lines: fight_id, source_id, pos, field, value_key, display."""
    weight, title = "case rf when 'A' then 'Super Lightweight' else 'Welterweight' end", "case rf when 'A' then 'WBC interim' else 'WBO' end"
    return f"""
  select fight_id, source_id, 0 as pos, 'winner' as field, winner as value_key, w as display from {ok}
  union all select fight_id, source_id, 1, 'method', {case('kind', METHOD_KEYS)}, {case('kind', METHOD_KEYS)} from {ok}
  union all select fight_id, source_id, 2, 'round', rnd::varchar, rnd::varchar from {ok} where kind < 2
  union all select fight_id, source_id, 3, 'time', clock, clock from {ok} where kind < 2
  union all select fight_id, source_id, 4, 'scheduled_rounds', '12', '12' from {ok} where q % 7 = 0
  union all select fight_id, source_id, 5, 'weight_class', {weight}, {weight} from {ok} where rf in ('A', 'N')
  union all select fight_id, source_id, 6, 'titles', {title}, {title} from {ok} where rf in ('A', 'N')
  union all select fight_id, source_id, 7, 'scorecards', '{CARDS}', replace('{CARDS}', ',', ', ') from {ok} where kind in (2, 3)
  union all select fight_id, source_id, 8, 'referee', case q % 4 when 0 then 'tom reed' else 'ana poe' end, case q % 4 when 0 then 'Tom Reed' else 'Ana Poe' end from {ok} where q % 4 < 2"""


def line_knockdowns(ok: str) -> str:
    return f"select fight_id, source_id, loser as victim, 1 + q % 4 as round, case when q % 6 = 0 then 2 else 1 end as count from {ok} where q % 3 = 0"


def grading(fights: str) -> str:
    """CTEs fields, named, ev, graded, res, grid and kd, from facts, downs and src (fight_id, source_id, tier, publisher)."""
    rank = "when bool_or(tier = 'Official') then 4 when count(distinct publisher) >= 2 then 3 else 2 end"
    return f"""
fields(field, label, pos, multi) as (values {_FIELD_ROWS}),
named as (select distinct fight_id from facts where field = 'method' and value_key in ('UD', 'SD', 'MD', 'TD')),
ev as (select f.*, tier, publisher from facts f join src using (fight_id, source_id) where not (field = 'method' and value_key = 'PTS' and fight_id in (select fight_id from named))),
graded as (
  select fight_id, field, value_key, arg_min(display, source_id) as display, min(source_id) as ord, list_sort(list(distinct source_id)) as ids, case {rank} as rank from ev group by fight_id, field, value_key
),
res as (
  select fight_id, g.field, case when not any_value(multi) and count(*) > 1 then 0 else min(rank) end as rank, list_sort(list_distinct(flatten(list(ids)))) as ids, count(*) as n_values,
         case when any_value(multi) then string_agg(display, ', ' order by ord) else string_agg(display, ' / ' order by -rank, -len(ids), ord) end as value,
         string_agg(display || ' (' || array_to_string(list_transform(ids, lambda i: '[' || i || ']'), ', ') || ')', '; ' order by -rank, -len(ids), ord) as shown
  from graded g join fields on g.field = fields.field group by fight_id, g.field
),
grid as (
  select f.fight_id, fields.field, fields.pos, coalesce(rank, 1) as rank, coalesce(value, 'Not found') as value, coalesce(array_to_string(ids, ','), '') as source_ids, coalesce(n_values, 0)::bigint as n_values
  from ({fights}) f cross join fields left join res on res.fight_id = f.fight_id and res.field = fields.field
),
kd as (
  select fight_id, victim, round, list_sort(list(distinct count)) as counts, list_sort(list(distinct source_id)) as ids, case when count(distinct count) > 1 then 0 {rank} as rank
  from downs join src using (fight_id, source_id) group by fight_id, victim, round
)"""
