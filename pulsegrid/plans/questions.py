"""Questions, search and ranking as queries, with their SQL forms.

Questions are made from ``events`` by rule: an intent, a category, an area and
a window each, so the SQL forms can state what must be read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import questions, ranking
from pulsegrid.operators.range_join import MINUTE, near_in_place_and_time
from pulsegrid.plans.analytics import DAY, NOW, _WITH
from pulsegrid.plans.feeds import _rules
from pulsegrid.sources.observations import observations

_INTENTS = ("how many", "show me", "anything about", "why are there")
_WHAT = ("car break-ins", "fires", "welfare checks", "purple balloons", "gas leaks")
_WHERE = ("in the mission", "near soma", "in N7", "")
_WHEN = ("in the last 6 hours", "today", "right now?", "past 2 weeks", "")


def _pick(values: tuple[str, ...], by) -> object:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    parts = (_pick(_INTENTS, F.col("id")), _pick(_WHAT, F.col("user_id")), _pick(_WHERE, F.col("k")), _pick(_WHEN, F.floor(F.col("k") / 4)))
    return rows.select("id", F.concat_ws(" ", *parts).alias("question"))


def parse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).select("id", questions.parse(F.col("question"), ("N7",)).alias("q"))
    return rows.select(
        "id", F.col("q.intent").alias("intent"), F.col("q.area").alias("area"), F.col("q.minutes").alias("minutes"), F.col("q.window").alias("window"),
        F.array_join("q.types", ",").alias("types"), F.array_join("q.codes", ",").alias("codes"), F.col("q.category").alias("category"),
        F.col("q.unanswerable").isNotNull().alias("refused"), F.array_join("q.unresolved", " ").alias("unresolved"), questions.valid(F.col("q")).alias("valid"),
    )


def match_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir)
    return rows.select("id", F.array_join(questions.match_terms(F.concat(F.col("question"), F.lit(" sex"))), " ").alias("terms"))


def expand_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick(("shots and smoke", "medical aid nearby", "a collision", "graffiti", "nothing"), F.col("user_id"))
    rows = observations(spark, sf_dir).select("id", said.alias("question"))
    done = questions.expand(rows, _rules(spark))
    return done.select("id", F.array_join("types", ",").alias("types"), F.array_join("codes", ",").alias("codes"), F.array_join("matched", ",").alias("matched"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a day with the number of other sources within half an hour and 450 m."""
    rows = observations(spark, sf_dir)
    day = rows.where(F.col("us").between(NOW - DAY, NOW))
    met = near_in_place_and_time(day.select("id", "us", "lat", "lng", "source"), rows.select("id", "us", "lat", "lng", "source"), 450.0, 30 * MINUTE, 30 * MINUTE).where("source <> o_source")
    others = met.groupBy("id").agg(F.count_distinct("o_source").alias("others"))
    joined = day.join(others, "id", "left")
    units = F.concat("units", F.when(F.col("k") % 8 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")))
    return joined.select("id", "us", "type", ranking.highlight_score(F.col("type"), F.col("priority_rank"), units, F.col("others")).alias("score"))


def highlight_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most notable calls of a day, a top-k report."""
    return ranking.highlights(_scored(spark, sf_dir))


def merged_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty hits: keyword hits by score, then calls of the category by recency, a top-k report."""
    rows = observations(spark, sf_dir)
    keyword = rows.where("k = 7 and id % 16 = 3").select("id", (F.col("id") % 100).cast("double").alias("lexical"))
    return ranking.merged_hits(keyword, rows.where("type = 'collision'").select("id", "us"), 30)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return rows.select(
        F.col("user_id").alias("query"), "id", (F.col("id") % 100).cast("double").alias("lexical"), F.when(F.col("k") % 3 != 0, (F.col("k") % 9) / 2).alias("relevance"),
        ((F.col("k") % 10) / 10).alias("confidence"),
    )


def rerank_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rerank(_hits(spark, sf_dir)).select("query", "id", F.round("final", 9).alias("final"))


def rerank_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.worth_reordering(_hits(spark, sf_dir).where("id % 40 = 0"))


def retrieval_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).groupBy(F.col("user_id").alias("query"), F.when(F.col("type") == "theft", "public_safety").otherwise(F.col("type")).alias("type")).agg((F.max("k") / 100).alias("likelihood"))
    return ranking.retrieval_plan(rows).select("query", F.array_join("types", ",").alias("types"))


def judge_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verdicts given beside the decisions would change."""
    decision = _pick(("merged", "probable", "created", "probable"), F.col("id"))
    level = F.when(F.col("k") % 7 != 0, (F.col("k") % 31) / 10)
    moved = ranking.judged(decision, level, (F.col("user_id") % 10) / 10)
    return observations(spark, sf_dir).groupBy(decision.alias("decision"), moved.alias("after")).agg(F.count("*").alias("calls"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_questions, match_terms, expand_questions, highlight_scores, highlights, merged_search_hits, rerank_hits, rerank_spread, retrieval_types, judge_moves,
    )
}

_SCORES = f"""{_WITH}, day as (select * from obs where us between {NOW - DAY} and {NOW}),
  near as (select a.id, count(distinct b.source) others from day a join obs b on b.us between a.us - {30 * MINUTE} and a.us + {30 * MINUTE} and a.source <> b.source
    where 2 * 6371008.8 * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lng - a.lng) / 2) ** 2))) <= 450.0 group by a.id),
  scored as (select id, us, type, cast(case type when 'assault' then 4 when 'collision' then 3 when 'medical' then 1 when 'theft' then 1 else 0 end + case when priority_rank <= 2 then 3 - priority_rank else 0 end
    + case when k % 8 = 0 then 2 else 0 end + case when others > 0 then 2 + others else 0 end as bigint) as score from day left join near using (id))"""
_MADE_HITS = f"""{_WITH}, hits as (select user_id as query, id, (id % 100)::double as lexical, case when k % 3 <> 0 then (k % 9) / 2.0::double end as relevance, (k % 10) / 10.0::double as confidence from obs)"""

ORACLE_SQL = {
    "parse_questions": f"""{_WITH}, a as (select id, cast(id % 4 as int) i, cast(user_id % 5 as int) w, k % 4 p, (k // 4) % 5 t from obs)
        select id, ['count', 'list', 'highlight', 'list'][i + 1] as intent, ['Mission', 'South of Market', 'N7', null][p + 1] as area, cast([360, 1440, 60, 20160, 180][t + 1] as int) as minutes,
          ['the last 6 hours', 'the last 24 hours', 'the last hour', 'the last 2 weeks', 'the last 3 hours'][t + 1] as "window", ['theft', 'fire', 'medical,public_safety', '', 'hazard'][w + 1] as types,
          ['852', '', '800,801,910', '', ''][w + 1] as codes, ['car break-ins', 'fires', 'welfare and mental-health calls', null, 'hazards'][w + 1] as category, i = 3 as refused,
          concat_ws(' ', case when i = 3 then 'why' end, case when w = 3 then 'purple balloons' end) as unresolved, true as valid from a""",
    "match_terms": f"""{_WITH}, a as (select id, cast(id % 4 as int) i, cast(user_id % 5 as int) w, k % 4 p, (k // 4) % 5 t from obs)
        select id, concat_ws(' ', ['how* many*', null, 'anything*', 'why* are*'][i + 1], ['car* break-ins*', 'fires*', 'welfare* checks*', 'purple* balloons*', 'gas* leaks*'][w + 1],
          ['mission*', 'soma*', null, null][p + 1], ['last* hours*', 'today*', 'right* now*', 'past* weeks*', null][t + 1], 'sex') as terms from a""",
    "expand_questions": f"""{_WITH}, a as (select id, cast(user_id % 5 as int) w from obs)
        select id, ['fire,weapon', 'medical', 'collision', 'disturbance', ''][w + 1] as types, ['216,216S,221,211S', 'click', 'ERROR', '594,595', ''][w + 1] as codes,
          ['fires,gunfire,fire', 'medical calls', 'collisions', 'vandalism', ''][w + 1] as matched from a""",
    "highlight_scores": f"{_SCORES} select * from scored",
    "highlights": f"{_SCORES} select * from scored order by score desc, us desc, id limit 3",
    "merged_search_hits": f"""{_WITH}, kw as (select id, (id % 100)::double as lexical, 'keyword' as via, null::bigint as us from obs where k = 7 and id % 16 = 3),
        cat as (select id, 0.0::double as lexical, 'category' as via, us from obs where type = 'collision' and id not in (select id from kw))
        select id, lexical, via from (select * from kw union all select * from cat) order by via desc, lexical desc, us desc, id limit 30""",
    "rerank_hits": f"""{_MADE_HITS}, s as (select *, min(lexical) over (partition by query) lo, max(lexical) over (partition by query) hi from hits), n as (select *, case when hi = lo then 0.5 else (lexical - lo) / (hi - lo) end as scaled from s)
        select query, id, round(case when relevance is not null and confidence >= 0.35 then 0.8 * relevance / 4 + 0.2 * scaled else scaled end, 9) as final from n""",
    "rerank_spread": f"""{_MADE_HITS}, r as (select query, coalesce(case when confidence >= 0.35 then relevance end, 0.0) as v from hits where id % 40 = 0)
        select query, max(v) - min(v) as spread, max(v) - min(v) >= 0.5 as reorder from r group by query""",
    "retrieval_types": f"""{_WITH}, t as (select user_id as query, case type when 'theft' then 'public_safety' else type end as type, max(k) / 100.0::double as likelihood from obs group by 1, 2),
        s as (select * from t where likelihood >= 0.6 and type not in ('public_safety', 'police_activity', 'unknown')), b as (select query, max(likelihood) as top from s group by query),
        c as (select s.* from s join b using (query) where -likelihood <= -top + 0.15 qualify row_number() over (partition by query order by likelihood desc, type) <= 3),
        l as (select query, string_agg(type, ',' order by likelihood desc, type) as types from c group by query)
        select query, coalesce(types, '') as types from (select distinct query from t) left join l using (query)""",
    "judge_moves": f"""{_WITH}, d as (select ['merged', 'probable', 'created', 'probable'][cast(id % 4 as int) + 1] as decision, case when k % 7 <> 0 then (k % 31) / 10.0::double end as lvl, (user_id % 10) / 10.0::double as conf from obs)
        select decision, case when decision = 'probable' and conf >= 0.6 and lvl is not null then case when lvl >= 2.4 then 'merged' when lvl <= 1.2 then 'created' else 'probable' end else decision end as after, count(*) as calls from d group by all""",
}
