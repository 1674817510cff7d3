"""Pieces of DuckDB SQL that repeat the engine's expressions, for checks of its results."""

from __future__ import annotations

from wayfind.functions import text as T
from wayfind.operators.match import FIELD_WEIGHT, KIND_WEIGHT


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    x = f"translate({x}, {_quote(''.join(T.SINGLE))}, {_quote(''.join(T.SINGLE.values()))})"
    for k, v in T.DOUBLE.items():
        x = f"replace({x}, {_quote(k)}, {_quote(v)})"
    return x


def normalize(x: str, apart: bool = True) -> str:
    point, comma, dollar, cubic = (f"chr({ord(c)})" for c in (T.POINT, T.COMMA, T.DOLLAR, T.CUBIC))
    x = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\$[0-9A-Fa-f]{{6}}', '', 'g'), '[\x00-\x1F\x7F]', '', 'g')"
    x = f"translate({fold(x)}, '{T.UPPER}', '{T.LOWER}')"
    for a, b in T.PROTECTED:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"replace(replace({x}, 'r$', ' r' || {dollar} || ' '), '$', ' ' || {dollar} || ' ')"
    x = rf"regexp_replace({x}, '([€£])', ' \1 ', 'g')"
    for mark, c in ((point, r"\."), (comma, ",")):
        for _ in range(2):
            x = rf"regexp_replace({x}, '([0-9]){c}([0-9])', '\1' || {mark} || '\2', 'g')"
    x = f"replace({x}, 'm3', {cubic})"
    x = rf"regexp_replace(regexp_replace({x}, '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g')" if apart else x
    x = rf"regexp_replace({x}, '[!-/:-@\[-`{{-~]', ' ', 'g')"
    x = f"replace(translate({x}, {point} || {comma} || {dollar}, '.,$'), {cubic}, 'm3')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"


def grams(x: str) -> str:
    p = f"('$' || {x} || '$')"
    return f"case when length({x}) >= 3 then list_transform(range(1, length({p}) - 1), lambda i: substr({p}, i, 3)) else [] end"


def osa(a: str, b: str) -> str:
    return f"""list_reduce(range(1, length({a}) + 1),
      lambda m, i: {{'before': m.last, 'last': list_reduce(range(1, length({b}) + 1),
        lambda r, j: list_append(r, least(m.last[j+1] + 1, r[j] + 1, m.last[j] + (case when {a}[i] = {b}[j] then 0 else 1 end),
          case when i > 1 and j > 1 and {a}[i] = {b}[j-1] and {a}[i-1] = {b}[j] then m.before[j-1] + 1 else 9999 end)), [i])}},
      {{'before': range(0, length({b}) + 1), 'last': range(0, length({b}) + 1)}}).last[length({b}) + 1]"""


def max_distance(n: str) -> str:
    return f"case when {n} <= 3 then 0 when {n} <= 5 then 1 when {n} <= 9 then 2 else 3 end"


def choose(of: str, values: dict[str, float]) -> str:
    return "case " + of + " " + " ".join(f"when '{k}' then {v}::double" for k, v in values.items()) + " end"


FIELD, KIND = choose("field", FIELD_WEIGHT), choose("kind", KIND_WEIGHT)

#: The part catalog and its index.
PARTS = f"""items as (
  select p_partkey as item_id, 'part/' || p_partkey as key, p_name as name, p_brand as brand, p_type as category, p_retailprice as price, p_size::double as power from part
), named as (
  select n, {normalize("n")} as norm from (select distinct unnest([p_name, p_brand, p_type]) as n from part)
), fields as (
  select item_id, field, prio, norm, string_split(norm, ' ') as tokens
  from (select item_id, unnest(['name', 'brand', 'category']) as field, unnest([0, 1, 2]) as prio, unnest([name, brand, category]) as n from items) join named using (n) where norm <> ''
), postings as (select distinct unnest(tokens) as token, item_id, field, prio from fields
), vocabulary as (select token, count(distinct item_id) as df, ln(1 + (select count(*) from items) / count(distinct item_id)) as idf from postings group by token
), words as (select token, gram, count(*) as times from (select token, unnest({grams("token")}) as gram from vocabulary) group by all
), numeric as (select 'price' as spec_id, price as value, item_id from items union all select 'power', power, item_id from items)"""

#: Hits of terms (query_id, pos, text), to their best field by item, scores and ranks.
HITS = f"""exact as (
  select query_id, pos, token, 'exact' as kind, 1.0::double as sim from terms join vocabulary on text = token
), buckets as (
  select token, prefix from (select token, unnest(list_transform(range(2, least(6, length(token)) + 1), lambda i: token[1:i])) as prefix from vocabulary)
  qualify row_number() over (partition by prefix order by token) <= 50
), begun as (
  select query_id, pos, token, 'prefix' as kind, greatest(0.5, strlen(text) / strlen(token)) as sim
  from terms join buckets on length(text) >= 2 and prefix = text[1:6] and starts_with(token, text) and token <> text
), direct as (select * from exact union all select * from begun
), unknown as (
  select query_id, pos, text, {max_distance("length(text)")} as d from terms where not exists (select 1 from direct x where x.query_id = terms.query_id and x.pos = terms.pos)
), shared as (
  select query_id, pos, text, d, token, sum(times) as shared from (select *, unnest({grams("text")}) as gram from unknown where d > 0) join words using (gram)
  where abs(length(token) - length(text)) <= d group by all having sum(times) >= greatest(1, length(text) - 3 * d)
), near as (
  select *, {osa("text", "token")} as dist from (select * from shared qualify row_number() over (partition by query_id, pos order by shared desc, token) <= 200)
), hits as (
  select * from direct
  union all select query_id, pos, token, case when dist <= 1 then 'fuzzy1' else 'fuzzy2' end, 1 - dist / greatest(length(text), length(token)) from near where dist <= d
), valued as (
  select query_id, pos, item_id, {FIELD} * {KIND} * sim as value, field, kind, token, sim, prio from hits join postings using (token)
), best as (
  select * from valued qualify row_number() over (partition by query_id, pos, item_id order by value desc, prio, token) = 1
)"""
RANKED = """weighed as (select t.*, coalesce(idf, 1.0) as idf from terms t left join vocabulary v on t.text = v.token
), totals as (select query_id, sum(idf) as most, count(*) as n from weighed group by query_id
), scored as (
  select query_id, item_id, least(1.0, greatest(0.0, sum(value * idf) / any_value(most) * (0.5 + 0.5 * count(*) / any_value(n))
           - sum(case when kind = 'prefix' and length(text) <= 3 then 0.1 else 0.0 end))) as score, count(*) / any_value(n) as coverage
  from best join weighed using (query_id, pos) join totals using (query_id) group by query_id, item_id
)"""
CUT = """ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, coverage desc, norm, key, item_id) as rank, item_id, key, score, coverage
  from (select *, max(score) over (partition by query_id) as top from candidates) join items using (item_id) join (select item_id, norm from fields where field = 'name') using (item_id)
  where score >= greatest(0.15, 0.25 * top)
)"""
