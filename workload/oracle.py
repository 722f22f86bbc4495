"""SQL counterparts of the registered queries, for DuckDB on the given tables.

Each text states the plain definition: self joins where the jobs use windows,
long rows where the jobs use wide ones, windows where they use aggregates.
"""

from __future__ import annotations

from furlong import registry
from furlong.plans.scoring import (
    ABOVE_BASELINE, BELOW_BASELINE, DISCLAIMER, INTERVAL_GOOD, INTERVAL_LAYOFF, INTERVAL_SHORT, INTERVAL_STANDARD, LABELS, LOWERED, RAISED, TIMED,
)
from furlong.functions.scalars import DIRT_MARKS, TURF_MARKS
from furlong.sources.scoring_config import BUILT_IN, ScoringConfig

EARLY, LATE = "1998-01-01", "1999-01-01"

# --- domain tables -----------------------------------------------------------

_RACES = """
r_races as (
  select o_orderkey as race_id, cast(o_orderdate as date) as race_date, r_name as venue,
    1 + o_orderkey % 12 as race_number, 'Race ' || o_orderkey as name, o_orderdate as start_at,
    case when o_orderpriority in ('1-URGENT','2-HIGH') then '芝'
         when o_orderpriority in ('3-MEDIUM','4-NOT SPECIFIED') then 'ダート' else '障害' end as surface,
    1000 + 200 * (o_orderkey % 3) as distance_meters,
    case o_orderstatus when 'F' then '良' when 'O' then '重' end as track_condition,
    case o_orderstatus when 'F' then 'confirmed' when 'O' then 'scheduled' else 'cancelled' end as status,
    o_orderdate - interval 7 day as available_at, o_orderdate - interval 6 day as observed_at
  from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

_ENTRIES = """
r_entry_base as (
  select * from (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey,
    l_extendedprice, l_shipdate, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax) as rn from lineitem) t
  where rn = 1),
r_entries as (
  select l_orderkey * 1000000 + l_partkey as entry_id, l_orderkey as race_id, l_partkey as horse_id,
    l_suppkey as jockey_id, l_suppkey % 7 as trainer_id,
    row_number() over (partition by l_orderkey order by l_partkey) as horse_number,
    50 + cast(l_quantity as int) % 10 as assigned_weight,
    case when l_partkey % 11 <> 0 then 400 + l_partkey % 120 end as body_weight,
    case when l_partkey % 5 <> 0 then l_linenumber - 4 end as body_weight_diff,
    case when l_linestatus = 'F' then 'running' else 'entered' end as status,
    o_orderdate - interval 3 day as available_at
  from r_entry_base join orders on l_orderkey = o_orderkey),
r_results as (
  select l_orderkey * 1000000 + l_partkey as entry_id,
    case when fin = 1 then row_number() over (partition by l_orderkey, fin order by l_extendedprice desc, l_partkey) end
      as finish_position,
    case when fin = 1 then 'finished' else 'did_not_finish' end as finish_status,
    case when fin = 1 then 60000 + cast(floor(l_extendedprice) as int) end as finish_time_ms,
    1 + l_partkey % 50 as final_odds,
    case when l_linestatus = 'F' then 'confirmed' else 'preliminary' end as status,
    o_orderdate + interval 1 day * l_linenumber as available_at,
    o_orderdate + interval 1 day * (l_linenumber + 1) as observed_at
  from (select *, case when l_returnflag = 'R' and l_linestatus = 'O' then 0 else 1 end as fin from r_entry_base
    where not (l_returnflag = 'A' and l_linestatus = 'O')) x join orders on l_orderkey = o_orderkey)"""

_TABLES = f"{_RACES},{_ENTRIES}"


def _visible(*instants: str) -> str:
    values = ", ".join(f"(timestamp '{at} 00:00:00')" for at in instants)
    return f"""
instants as (select * from (values {values}) v(as_of_at)),
vis as materialized (
  select e.entry_id, e.race_id, e.horse_id, e.jockey_id, e.horse_number, r.race_date, r.start_at, r.venue, r.surface,
    case when contains(r.surface, '芝') then 'turf' when contains(r.surface, 'ダート') then 'dirt' else 'other' end as sc,
    r.distance_meters as dist, r.track_condition as cond, i.as_of_at
  from r_entries e join r_races r on e.race_id = r.race_id cross join instants i
  where r.available_at <= i.as_of_at and e.available_at <= i.as_of_at),
past as materialized (
  select v.*, x.finish_position as pos, x.finish_status as fs, x.finish_time_ms as ms,
    x.available_at as ra, x.observed_at as ro
  from vis v join r_results x on x.entry_id = v.entry_id where x.available_at <= v.as_of_at)"""


def _rate(part: str, whole: str) -> str:
    return f"cast(case when {whole} > 0 then {part}::double / {whole} end as decimal(18,6))"


_HORSE = f"""
hagg as materialized (
  select t.entry_id, t.as_of_at,
    count(p.entry_id) as n,
    date_diff('day', arg_max(p.race_date, p.start_at), any_value(t.race_date)) as days,
    count(*) filter (p.sc = t.sc) as s_n, count(*) filter (p.sc = t.sc and p.pos <= 3) as s_3,
    count(*) filter (p.dist = t.dist) as d_n, count(*) filter (p.dist = t.dist and p.pos <= 3) as d_3,
    min(p.ms) filter (p.sc = t.sc and p.dist = t.dist and p.fs = 'finished') as best,
    count(p.ms) filter (p.sc = t.sc and p.dist = t.dist and p.fs = 'finished') as best_n,
    count(*) filter (p.cond = t.cond) as c_n, count(*) filter (p.cond = t.cond and p.pos <= 3) as c_3,
    count(*) filter (p.venue = t.venue and p.sc = t.sc and p.dist = t.dist) as v_n,
    count(*) filter (p.venue = t.venue and p.sc = t.sc and p.dist = t.dist and p.pos <= 3) as v_3,
    max(p.ra) as h_ra, max(p.ro) as h_ro
  from vis t left join past p on p.horse_id = t.horse_id and p.as_of_at = t.as_of_at and p.start_at < t.start_at
  group by t.entry_id, t.as_of_at),
hf as (
  select v.entry_id, v.race_id, v.horse_id, v.jockey_id, v.as_of_at,
    days as horse_days_since_last_race, n > 0 as horse_has_past_race, days >= 56 as horse_is_after_layoff_8w,
    s_n as horse_surface_starts, {_rate('s_3', 's_n')} as horse_surface_top3_rate,
    d_n as horse_distance_starts, {_rate('d_3', 'd_n')} as horse_distance_top3_rate,
    best as horse_best_time_same_surface_distance_ms, best_n as horse_best_time_same_surface_distance_count,
    c_n as horse_track_condition_starts, {_rate('c_3', 'c_n')} as horse_track_condition_top3_rate,
    v_n as horse_course_starts, {_rate('v_3', 'v_n')} as horse_course_top3_rate,
    h_ra as horse_available_until, h_ro as horse_observed_until
  from vis v join hagg h on v.entry_id = h.entry_id and v.as_of_at = h.as_of_at)"""

# Earlier starts as a frame that ends before the row's own instant: a self join of a jockey's starts takes too long.
_JOCKEY = f"""
hist as materialized (
  select v.*, p.pos, p.ra, p.ro from vis v left join past p on p.entry_id = v.entry_id and p.as_of_at = v.as_of_at),
jagg as materialized (
  select entry_id, as_of_at,
    count(ra) over at_venue as v_n, count(ra) filter (pos = 1) over at_venue as v_1, count(ra) filter (pos <= 3) over at_venue as v_3,
    count(ra) over at_dist as d_n, count(ra) filter (pos = 1) over at_dist as d_1, count(ra) filter (pos <= 3) over at_dist as d_3,
    max(ra) over at_venue as v_ra, max(ro) over at_venue as v_ro, max(ra) over at_dist as d_ra, max(ro) over at_dist as d_ro
  from hist
  window at_venue as (partition by jockey_id, as_of_at, venue order by start_at
                      range between unbounded preceding and interval 1 microsecond preceding),
         at_dist as (partition by jockey_id, as_of_at, dist order by start_at
                     range between unbounded preceding and interval 1 microsecond preceding)),
jf as (
  select v.entry_id, v.race_id, v.horse_id, v.jockey_id, v.as_of_at,
    v_n as jockey_venue_starts, v_1 as jockey_venue_wins, v_3 as jockey_venue_top3,
    {_rate('v_1', 'v_n')} as jockey_venue_win_rate, {_rate('v_3', 'v_n')} as jockey_venue_top3_rate,
    d_n as jockey_distance_starts, d_1 as jockey_distance_wins, d_3 as jockey_distance_top3,
    {_rate('d_1', 'd_n')} as jockey_distance_win_rate, {_rate('d_3', 'd_n')} as jockey_distance_top3_rate,
    v_ra as jockey_venue_available_until, v_ro as jockey_venue_observed_until,
    d_ra as jockey_distance_available_until, d_ro as jockey_distance_observed_until
  from vis v join jagg j on v.entry_id = j.entry_id and v.as_of_at = j.as_of_at)"""

_FEATURES = f"""{_HORSE},{_JOCKEY},
feat as materialized (
  select hf.*, jf.* exclude (entry_id, race_id, horse_id, jockey_id, as_of_at)
  from hf join jf on hf.entry_id = jf.entry_id and hf.as_of_at = jf.as_of_at)"""


def _marks(key: str) -> str:
    if key.startswith("horse."):
        return "horse"
    return "jockey_venue" if key.startswith("jockey.venue") else "jockey_distance"


def _long(source: str, keys=None) -> str:
    parts = []
    for feature in registry.ALL:
        if keys is not None and feature.key not in keys:
            continue
        number = f"cast({feature.column} as decimal(18,6))" if feature.is_number else "cast(null as decimal(18,6))"
        truth = "cast(null as boolean)" if feature.is_number else feature.column
        marks = _marks(feature.key)
        parts.append(
            f"select entry_id, race_id, horse_id, as_of_at, '{feature.key}' as feature_key, {number} as value_number, "
            f"{truth} as value_boolean, {marks}_available_until as ra, {marks}_observed_until as ro from {source}"
        )
    return "(" + "\n union all ".join(parts) + ")"


_ONE = f"with {_TABLES},{_visible(LATE)}"
_BOTH = f"with {_TABLES},{_visible(EARLY, LATE)}"
_BOTH_FEATURES = f"{_BOTH},{_FEATURES}"
_LATE_FEATURES = f"{_ONE},{_FEATURES}"


def _columns(prefix: str, table: str = "", plain: bool = True) -> str:
    """Feature columns of one prefix; stored decimals are shown as doubles."""
    names = []
    for feature in registry.ALL:
        if feature.key.startswith(prefix):
            column = f"{table}{feature.column}"
            names.append(f"cast({column} as double) as {feature.column}" if plain and feature.key.endswith("_rate") else column)
    return ", ".join(names)


_HORSE_MARKS = "horse_available_until, horse_observed_until"
_JOCKEY_MARKS = (
    "jockey_venue_available_until, jockey_venue_observed_until, "
    "jockey_distance_available_until, jockey_distance_observed_until"
)

# --- scoring -----------------------------------------------------------------


def _r3(x: str) -> str:
    return f"(floor(({x}) * 1000::double + 0.5::double) / 1000::double)"


def _r4(x: str) -> str:
    return f"(floor(({x}) * 10000::double + 0.5::double) / 10000::double)"


def _d(value) -> str:
    return f"({float(value)!r})::double"


def _rules(config: ScoringConfig) -> list[dict[str, str]]:
    """Per component: key, label, value, adjustment (null when absent) and reason."""
    rules = []
    for key, label in LABELS.items():
        rule = config.features[key]
        column = registry.BY_KEY[key].column if key in registry.BY_KEY else ""
        number, truth, shown = f"cast({column} as double)", "cast(null as boolean)", key
        if rule["type"] == "boolean":
            adjustment = (
                f"case when {column} is null then null when {column} = {str(rule['positiveValue']).lower()} "
                f"then {_d(rule['positiveAdjustment'])} else {_d(rule['negativeAdjustment'])} end"
            )
            reason = f"case when ({adjustment}) >= 0 then '{label}{RAISED}' else '{label}{LOWERED}' end"
            number, truth = "cast(null as double)", column
        elif rule["type"] == "interval_days":

            def pick(short, layoff, good, standard, column=column, rule=rule):
                return (
                    f"case when {column} is null then null when {column} < {rule['shortThresholdDays']} then {short} "
                    f"when {column} >= {rule['layoffThresholdDays']} then {layoff} "
                    f"when {column} <= {rule['goodMaxDays']} then {good} else {standard} end"
                )

            adjustment = pick(*[_d(rule[f"{name}Adjustment"]) for name in ("short", "layoff", "good", "standard")])
            reason = pick(*[f"'{t}'" for t in (INTERVAL_SHORT, INTERVAL_LAYOFF, INTERVAL_GOOD, INTERVAL_STANDARD)])
        elif rule["type"] == "rate":
            raw = _r3(f"({number} - {_d(rule['baseline'])}) * {_d(rule['maxAdjustment'])}")
            adjustment = f"nullif({raw}, 0::double)"
            reason = f"case when {raw} > 0 then '{label}{ABOVE_BASELINE}' else '{label}{BELOW_BASELINE}' end"
        else:
            shown = rule["featureKey"]
            value = registry.BY_KEY[shown].column
            count = registry.BY_KEY[rule["countFeatureKey"]].column
            number = f"cast({value} as double)"
            confidence = (
                f"case when {count} is null then {_d(rule['defaultConfidence'])} else least(1::double, "
                f"greatest({_d(rule['minConfidence'])}, {count}::double / {_d(rule['fullConfidenceCount'])})) end"
            )
            adjustment = f"case when {value} is not null then {_r3(_d(rule['baseAdjustment']) + ' * (' + confidence + ')')} end"
            reason = f"'{TIMED}'"
        rules.append(
            {"key": shown, "label": label, "number": number, "truth": truth, "adjustment": adjustment, "reason": reason}
        )
    return rules


def _score(config: ScoringConfig) -> str:
    total = " + ".join(f"coalesce({rule['adjustment']}, 0::double)" for rule in _rules(config))
    return f"least({_d(config.high)}, greatest({_d(config.low)}, {_r3(f'{_d(config.base)} + (0::double + {total})')}))"


def _components(config: ScoringConfig, source: str) -> str:
    return "\n union all ".join(
        f"select entry_id, as_of_at, '{config.model_version}' as model_version, {nth} as nth, '{rule['key']}' as feature_key, "
        f"'{rule['label']}' as label, {rule['number']} as value_number, {rule['truth']} as value_boolean, "
        f"{rule['adjustment']} as adjustment, {rule['reason']} as reason from {source} "
        f"where ({rule['adjustment']}) is not null"
        for nth, rule in enumerate(_rules(config))
    )


_ALL_COMPONENTS = "comps as (" + "\n union all ".join(_components(config, "feat") for config in BUILT_IN.values()) + ")"

_PREDICTIONS = (
    "scored as ("
    + " union all ".join(
        f"select *, '{config.model_version}' as model_version, {_score(config)} as score from feat"
        for config in BUILT_IN.values()
    )
    + f"""),
preds as (
  select model_version || ':' || epoch_us(s.as_of_at) || ':' || s.entry_id as prediction_id,
    model_version || '@' || strftime(s.as_of_at, '%Y-%m-%d') as run_id, model_version, s.as_of_at,
    s.race_id, s.entry_id, s.horse_id, s.jockey_id, score as prediction_score,
    row_number() over (partition by model_version, s.as_of_at, s.race_id order by score desc, v.horse_number) as rank_in_race
  from scored s join vis v on v.entry_id = s.entry_id and v.as_of_at = s.as_of_at),
runs as (
  select run_id, 'rule_based' as prediction_type, model_version, as_of_at, count(*) as total_count,
    case when model_version = 'rule-based-v1.1' and as_of_at = timestamp '{EARLY} 00:00:00' then 'failed' else 'succeeded' end
      as status, as_of_at as started_at
  from preds group by all)"""
)

_EVALUATIONS = """
judged as (
  select p.prediction_id, p.run_id, p.race_id, p.entry_id, p.rank_in_race as predicted_rank, p.prediction_score,
    x.finish_position, x.finish_status, x.available_at as result_available_at
  from preds p join runs r on r.run_id = p.run_id and r.status = 'succeeded' join r_results x on x.entry_id = p.entry_id),
placed as (
  select *, row_number() over (partition by run_id, race_id order by coalesce(predicted_rank, 999)) as place,
    first_value(entry_id) over (partition by run_id, race_id order by coalesce(predicted_rank, 999)) as top_entry_id,
    first_value(finish_position) over (partition by run_id, race_id order by coalesce(predicted_rank, 999)) as top_position,
    min(predicted_rank) filter (finish_position = 1) over (partition by run_id, race_id) as winner_rank
  from judged),
evals as (
  select prediction_id, run_id, race_id, entry_id, predicted_rank, prediction_score, finish_position, finish_status,
    entry_id = top_entry_id as is_predicted_top1, top_position as top_prediction_finish_position,
    top_position <= 3 as top_prediction_is_top3, coalesce(finish_position = 1, false) as is_actual_winner,
    coalesce(max(place) filter (predicted_rank = winner_rank) over (partition by run_id, race_id) <= 3, false)
      as actual_winner_in_predicted_top3,
    abs(predicted_rank - finish_position) as rank_diff, result_available_at,
    max(entry_id) filter (predicted_rank = winner_rank) over (partition by run_id, race_id) as winner_entry_id, top_entry_id
  from placed)"""

_BASE = """
base as (
  select p.prediction_id, p.run_id, p.model_version, p.as_of_at, p.race_id, p.entry_id, p.rank_in_race, e.rank_diff,
    e.is_predicted_top1, e.top_prediction_is_top3, e.actual_winner_in_predicted_top3, e.prediction_id is not null as done
  from preds p join runs r on r.run_id = p.run_id left join evals e on e.prediction_id = p.prediction_id)"""

_UP_TO_PREDICTIONS = f"{_BOTH_FEATURES},{_PREDICTIONS}"
_UP_TO_EVALUATIONS = f"{_UP_TO_PREDICTIONS},{_EVALUATIONS}"
_UP_TO_BASE = f"{_UP_TO_EVALUATIONS},{_BASE}"

_BASE_COLUMNS = (
    "prediction_id, run_id, model_version, race_id, rank_in_race, rank_diff, is_predicted_top1, "
    "top_prediction_is_top3, actual_winner_in_predicted_top3"
)

_METRICS = f"""
count(*) as prediction_count, count(rank_diff) as evaluated_prediction_count,
count(distinct case when rank_diff is not null then run_id || ':' || race_id end) as evaluated_race_count,
count(*) filter (is_predicted_top1 and top_prediction_is_top3 is not null) as top1_evaluated_race_count,
{_r4("count(*) filter (is_predicted_top1 and top_prediction_is_top3)::double / nullif(count(*) filter (is_predicted_top1 and top_prediction_is_top3 is not null), 0)")} as top1_top3_rate,
{_r4("count(*) filter (is_predicted_top1 and actual_winner_in_predicted_top3)::double / nullif(count(*) filter (is_predicted_top1 and actual_winner_in_predicted_top3 is not null), 0)")} as winner_in_predicted_top3_rate,
{_r4("sum(rank_diff)::double / nullif(count(rank_diff), 0)")} as average_rank_diff"""

_SMALL = "evaluated_race_count > 0 and evaluated_race_count < 30 as is_small_sample"
_BY_VERSION = f"byver as (select *, {_SMALL} from (select model_version, {_METRICS} from base group by model_version) x)"

_CONTRIBUTIONS = f"""{_ALL_COMPONENTS},
used as (select model_version, feature_key, label, cast(adjustment as decimal(38,12)) as adjustment
  from comps where adjustment <> 0)"""


def _contribution(keys: str) -> str:
    return (
        f"select {keys}, min(label) as label, count(*) as count, count(*) filter (adjustment > 0) as positive_count, "
        f"count(*) filter (adjustment < 0) as negative_count, {_r4('sum(adjustment)::double / count(*)')} as average_adjustment "
        f"from used group by {keys}"
    )


# --- import ------------------------------------------------------------------

# Faults of the race rows in rule order: column, divisor of the key, reason.
_FAULTS = (
    ("id", 73, "expected a UUID"),
    ("provider_code", 71, "a text is required"),
    ("race_date", 101, "expected a date YYYY-MM-DD"),
    ("venue", 97, "a text is required"),
    ("race_number", 89, "expected a whole number from 1 to 99"),
    ("scheduled_start_at", 79, "expected a datetime with offset"),
    ("distance_meters", 83, "expected a whole number from 1 to 2147483647"),
    ("status", 103, "expected one of scheduled, confirmed, cancelled"),
)
_FAULTY = " or ".join(f"race_id % {by} = 0" for _, by, _ in _FAULTS)
_FAILED_COLUMNS = "concat_ws(',', " + ", ".join(
    f"case when race_id % {by} = 0 then '{column}' end" for column, by, _ in _FAULTS
) + ")"


def _uuid(text: str) -> str:
    digest = f"sha256({text})"
    variant = (
        f"case when substr({digest}, 17, 1) in ('0','4','8','c') then '8' when substr({digest}, 17, 1) in ('1','5','9','d') "
        f"then '9' when substr({digest}, 17, 1) in ('2','6','a','e') then 'a' else 'b' end"
    )
    return (
        f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || {variant} || "
        f"substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12))"
    )


_RESOLVED = f"""
src as (
  select *, case when horse_id % 89 = 0 then 'X' || horse_id else 'H' || horse_id end as sh,
    case when jockey_id % 37 = 0 then 'X' || jockey_id else 'J' || jockey_id end as sj from r_entries),
checked as (
  select *, concat_ws(', ', case when sh like 'X%' then 'source_horse_id=' || sh end,
    case when sj like 'X%' then 'source_jockey_id=' || sj end) as missing from src)"""

_MERGED_RACES = """
stored as (
  select race_date, venue, race_number, min(race_id) as race_id, arg_max(name, race_id) as name, arg_max(status, race_id) as status
  from r_races where status = 'confirmed' group by race_date, venue, race_number),
incoming as (
  select race_date, venue, race_number, min(race_id) as race_id, arg_max(name, race_id) || ' (new)' as name,
    arg_max(status, race_id) as status from r_races group by race_date, venue, race_number),
merged as (
  select i.race_date, i.venue, i.race_number, coalesce(s.race_id, i.race_id) as race_id, i.name, i.status
  from incoming i left join stored s on s.race_date = i.race_date and s.venue = i.venue and s.race_number = i.race_number)"""

# --- labels ------------------------------------------------------------------

_TOTAL = "finish_time_ms::double / 1000::double"
_SECONDS = f"(({_TOTAL}) % 60::double)"
# Tenths nearest to the binary value, ties up, in exact integers (fraction scaled by 2^52).
_TENTHS = f"((cast(({_SECONDS} - floor({_SECONDS})) * 4503599627370496::double as hugeint) * 10 + 2251799813685248) // 4503599627370496)"
_TIME_LABEL = (
    f"case when finish_time_ms is null then '—' else cast(floor(({_TOTAL}) / 60) as bigint) || ':' || "
    f"lpad(cast(cast(floor({_SECONDS}) as bigint) + case when {_TENTHS} = 10 then 1 else 0 end as varchar), 2, '0') || '.' || "
    f"({_TENTHS} % 10) end"
)
_WEIGHT_LABEL = (
    "case when body_weight is null then '未発表' when body_weight_diff is null then body_weight || 'kg' "
    "else body_weight || 'kg (' || case when body_weight_diff > 0 then '+' else '' end || body_weight_diff || ')' end"
)
_FINISH_LABEL = (
    "case finish_status when 'did_not_finish' then '中止' when 'disqualified' then '失格' when 'scratched' then '取消' "
    "else coalesce(finish_position || '着', '—') end"
)

_BATCHES = """
batches as (
  select 'import-' || strftime(date_trunc('month', o_orderdate), '%Y-%m') as batch_id,
    case when month(any_value(o_orderdate)) % 2 = 0 then 'dry_run' else 'import' end as mode,
    case when count(*) filter (o_orderstatus = 'P') % 2 = 0 then 'succeeded' else 'failed' end as status,
    cast(date_trunc('month', o_orderdate) as timestamp) as started_at, count(*) as total_rows,
    count(*) filter (o_orderstatus = 'P') as failed_rows
  from orders group by date_trunc('month', o_orderdate))"""

_REASONS = "\n union all ".join(
    f"""select p.prediction_id, '{direction}' as direction,
  row_number() over (partition by p.prediction_id order by c.adjustment {order}, c.nth) as place,
  c.feature_key, c.adjustment, c.reason
from comps c join preds p on p.entry_id = c.entry_id and p.as_of_at = c.as_of_at and p.model_version = c.model_version
where c.adjustment {sign} 0"""
    for direction, order, sign in (("positive", "desc", ">"), ("negative", "asc", "<"))
)

_SURFACE_MIX = (
    f"case when race_id % 7 = 0 then 'ダート・' || surface when race_id % 11 = 0 then '{TURF_MARKS[1]}' "
    f"when race_id % 13 = 0 then '{DIRT_MARKS[1]}' else surface end"
)

ORACLES: dict[str, str] = {
    "csv_source": """
select 1 + 1 + sum(1 + (case when (o_orderkey - 0) % 53 = 0 then 1 else 0 end)) over (order by o_orderkey rows unbounded preceding)
    - 1 - (case when o_orderkey % 53 = 0 then 1 else 0 end) + 0 as row_number,
  cast(o_orderkey as varchar) as id,
  case when o_orderkey % 97 = 0 then 'first' || chr(10) || 'second, third' when o_orderkey % 89 = 0 then 'inside, afield' else 'Order "' || o_orderkey || '", ' || o_orderpriority end as label,
  o_orderstatus as status
from orders""",
    "csv_bundle_files": f"""with {_TABLES}
select 'races' as table_name, count(*) as row_count, count(distinct race_id) as source_ids,
  sum(length('R' || race_id)) as source_id_length, 2 as first_row from r_races
union all select 'horses', count(*), count(*), sum(length('H' || p_partkey)), 2 from part
union all select 'jockeys', count(*), count(*), sum(length('J' || s_suppkey)), 2 from supplier
union all select 'trainers', count(*), count(*), sum(length('T' || t)), 2 from (select distinct s_suppkey % 7 as t from supplier) x
union all select 'race_entries', count(*), count(distinct entry_id), sum(length('E' || entry_id)), 2 from r_entries
union all select 'race_results', count(*), count(distinct entry_id), sum(length('Z' || entry_id)), 2 from r_results""",
    "validate_rows": f"""with {_RACES}
select race_id + 2 as row_number, 'R' || race_id as source_id, not ({_FAULTY}) as is_valid, {_FAILED_COLUMNS} as failed_columns,
  case when race_id % 101 <> 0 then race_date end as race_date, case when race_id % 97 <> 0 then venue end as venue,
  case when race_id % 89 <> 0 then race_number end as race_number,
  case when race_id % 79 <> 0 then start_at end as scheduled_start_at,
  case when race_id % 83 <> 0 then distance_meters end as distance_meters,
  case when race_id % 103 <> 0 then status end as status
from r_races""",
    "import_errors": f"with {_RACES}, failed as ("
    + " union all ".join(
        f"select race_id, '{column}: {reason}' as error_message from r_races where race_id % {by} = 0"
        for column, by, reason in _FAULTS
    )
    + """)
select 'races.sample.csv' as file_name, race_id + 2 as row_number, 'race' as entity_type, 'R' || race_id as source_id,
  'VALIDATION_ERROR' as error_code, error_message,
  '- races.sample.csv / row ' || (race_id + 2) || ' / source R' || race_id || ': [VALIDATION_ERROR] ' || error_message as line
from failed""",
    "unique_violations": f"""with {_RACES}
select race_date, venue, race_number, count(*) as row_count from r_races group by all having count(*) > 1""",
    "deterministic_id": f"""
select p_partkey, case when p_partkey % 10 = 0 then 'part-' || p_partkey
  else {_uuid("'star:horse:' || p_name || '#' || p_partkey")} end as horse_id from part""",
    "normalize_surface": f"""with {_RACES}
select race_id, {_SURFACE_MIX} as surface,
  case when contains({_SURFACE_MIX}, '芝') or contains({_SURFACE_MIX}, '{TURF_MARKS[1]}') then 'turf'
       when contains({_SURFACE_MIX}, 'ダート') or contains({_SURFACE_MIX}, '{DIRT_MARKS[1]}') then 'dirt' else 'other' end as surface_class
from r_races""",
    "targets_as_of": f"""{_ONE}
select race_id, entry_id, horse_id, jockey_id, horse_number, race_date, start_at as scheduled_start_at, venue, surface,
  dist as distance_meters, cond as track_condition from vis""",
    "eligible_history": f"""{_ONE}
select entry_id, race_id, horse_id, jockey_id, race_date, start_at as scheduled_start_at, venue, sc as surface_class,
  dist as distance_meters, cond as track_condition, pos as finish_position, fs as finish_status,
  ms as finish_time_milliseconds, ra as result_available_at, ro as result_observed_at, as_of_at from past""",
    "horse_features": f"""{_ONE},{_HORSE}
select entry_id, race_id, horse_id, jockey_id, as_of_at, {_columns('horse.')}, {_HORSE_MARKS} from hf""",
    "jockey_features": f"""{_ONE},{_JOCKEY}
select entry_id, race_id, horse_id, jockey_id, as_of_at, {_columns('jockey.')}, {_JOCKEY_MARKS} from jf""",
    "features_wide": f"""{_BOTH_FEATURES}
select entry_id, race_id, horse_id, jockey_id, as_of_at, {_columns('')}, {_HORSE_MARKS}, {_JOCKEY_MARKS} from feat""",
    "features_long": f"""{_LATE_FEATURES}
select entry_id, feature_key, cast(value_number as double) as value_number, value_boolean from {_long('feat')} x""",
    "feature_lineage": f"""{_LATE_FEATURES}
select horse_id, feature_key, max(ra) as source_available_until, max(ro) as source_observed_until, count(ra) as sourced_snapshots
from {_long('feat')} x group by all""",
    "features_p0": f"""{_ONE},{_HORSE}
select entry_id, feature_key, cast(value_number as double) as value_number, value_boolean from {_long('hf', registry.P0_KEYS)} x""",
    "days_since_last": f"""{_ONE},{_HORSE}
select entry_id, horse_days_since_last_race, horse_is_after_layoff_8w from hf""",
    "latest_features": f"""{_BOTH_FEATURES}
select entry_id, feature_key, as_of_at, cast(value_number as double) as value_number, value_boolean
from (select *, row_number() over (partition by entry_id, feature_key order by as_of_at desc) as rn
  from {_long('feat')} x where as_of_at <= timestamp '{LATE} 00:00:00') y where rn = 1""",
    "latest_snapshots_between": f"""{_BOTH_FEATURES}
select feature_key, as_of_at, count(*) as entries, cast(sum(value_number) as double) as value_sum,
  count(*) filter (value_boolean) as true_count
from (select *, row_number() over (partition by entry_id, feature_key order by as_of_at desc) as rn
  from {_long('feat')} x where as_of_at <= timestamp '1998-06-01 00:00:00') y where rn = 1 group by all""",
    "features_pivot": f"""{_LATE_FEATURES}
select entry_id, as_of_at as latest_as_of_at, """
    + ", ".join(
        f"cast({f.column} as double) as {f.column}" if f.is_number else f.column for f in registry.ALL
    )
    + " from feat",
    "scores_v1": f"{_LATE_FEATURES} select entry_id, {_score(BUILT_IN['rule-based-v1'])} as score from feat",
    "scores_v11": f"{_LATE_FEATURES} select entry_id, {_score(BUILT_IN['rule-based-v1.1'])} as score from feat",
    "version_scores": f"""{_LATE_FEATURES}
select entry_id, {_score(BUILT_IN['rule-based-v1'])} as score_v1, {_score(BUILT_IN['rule-based-v1.1'])} as score_v11 from feat""",
    "score_components": f"""{_LATE_FEATURES},{_ALL_COMPONENTS}
select entry_id, model_version, feature_key, label, value_number, value_boolean, adjustment, reason from comps""",
    "predictions_ranked": f"""{_LATE_FEATURES},{_PREDICTIONS},{_ALL_COMPONENTS}
select p.prediction_id, p.run_id, p.race_id, p.entry_id, p.horse_id, p.jockey_id, p.as_of_at, p.prediction_score, p.rank_in_race,
  coalesce(c.n, 0) as component_count, p.as_of_at as snapshot_as_of_at
from preds p left join (select entry_id, model_version, count(*) as n from comps group by all) c
  on c.entry_id = p.entry_id and c.model_version = p.model_version""",
    "latest_predictions": f"""{_UP_TO_PREDICTIONS}
select entry_id, model_version, as_of_at, prediction_score, rank_in_race
from (select *, row_number() over (partition by entry_id order by as_of_at desc, model_version desc) as rn from preds) x where rn = 1""",
    "used_snapshots": f"""{_UP_TO_PREDICTIONS}
select run_id, feature_key, as_of_at, count(*) as predictions,
  max(entry_id || ':' || feature_key || ':1:' || epoch_us(as_of_at)) as last_id
from preds cross join (values {", ".join(f"('{f.key}')" for f in registry.ALL)}) k(feature_key) group by all""",
    "evaluations": f"{_UP_TO_EVALUATIONS} select * from evals",
    "evaluation_counts": f"""{_UP_TO_EVALUATIONS}
select count(distinct run_id) as target_runs, count(*) as target_predictions, count(*) as calculated_evaluations,
  count(*) filter (run_id not like '%@{EARLY}') as inserted_evaluations,
  count(*) filter (run_id like '%@{EARLY}') as updated_evaluations, 0 as skipped_predictions from evals""",
    "analytics_base": f"{_UP_TO_BASE} select {_BASE_COLUMNS} from base",
    "analytics_day": f"""{_UP_TO_BASE}
select {_BASE_COLUMNS} from base where model_version = 'rule-based-v1'
  and as_of_at >= timestamp '1998-12-31 15:00:00' and as_of_at < timestamp '1999-01-01 15:00:00'""",
    "eval_status_filter": f"{_UP_TO_BASE} select {_BASE_COLUMNS} from base where not done",
    "analytics_overall": f"{_UP_TO_BASE} select *, {_SMALL} from (select {_METRICS} from base) x",
    "analytics_by_version": f"{_UP_TO_BASE},{_BY_VERSION} select * from byver",
    "version_comparison": f"""{_UP_TO_BASE},{_BY_VERSION}
select b.model_version as base_model_version, c.model_version as candidate_model_version,
  c.evaluated_race_count - b.evaluated_race_count as evaluated_race_count_diff,
  c.evaluated_prediction_count - b.evaluated_prediction_count as evaluated_prediction_count_diff,
  {_r4('c.top1_top3_rate - b.top1_top3_rate')} as top1_top3_rate_diff,
  {_r4('c.winner_in_predicted_top3_rate - b.winner_in_predicted_top3_rate')} as winner_in_predicted_top3_rate_diff,
  {_r4('c.average_rank_diff - b.average_rank_diff')} as average_rank_diff_diff,
  b.is_small_sample or c.is_small_sample as is_small_sample
from byver b join byver c on b.model_version = 'rule-based-v1' and c.model_version = 'rule-based-v1.1'""",
    "feature_contribution": f"{_BOTH_FEATURES},{_CONTRIBUTIONS} {_contribution('feature_key')}",
    "contribution_by_version": f"{_BOTH_FEATURES},{_CONTRIBUTIONS} {_contribution('model_version, feature_key')}",
    "contribution_diff": f"""{_BOTH_FEATURES},{_CONTRIBUTIONS}, v as ({_contribution('model_version, feature_key')})
select feature_key, max(label) as label, max(average_adjustment) filter (model_version = 'rule-based-v1') as base_mean,
  max(average_adjustment) filter (model_version = 'rule-based-v1.1') as candidate_mean,
  {_r4("max(average_adjustment) filter (model_version = 'rule-based-v1.1') - max(average_adjustment) filter (model_version = 'rule-based-v1')")} as average_adjustment_diff
from v group by feature_key""",
    "component_parse": """
select o_orderkey, case when o_orderkey % 3 = 0 then 'unknown' else o_orderpriority end as feature_key,
  case when o_orderkey % 4 = 0 then '特徴量' else '表示' end as label,
  cast(round(o_totalprice / 1000, 1) as decimal(12,1))::double as adjustment
from orders where o_orderkey % 13 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and round(o_totalprice / 1000, 1) <> 0""",
    "races_list": f"""with {_RACES}
select race_id, race_date, venue, race_number, surface, distance_meters, status from r_races where venue = 'ASIA' and surface ilike '%芝%'""",
    "races_list_total": f"""with {_RACES}
select count(*) as total_count, greatest(1, cast(ceil(count(*) / 12.0) as bigint)) as total_pages from r_races where surface ilike '%ダート%'""",
    "races_page": f"""with {_RACES}
select race_id, race_date, venue, race_number, name, start_at as scheduled_start_at, surface, distance_meters, status, observed_at
from r_races where venue = 'EUROPE' order by start_at, race_number, race_id limit 12 offset 24""",
    "filter_options": f"""with {_RACES}
select 'race_date' as filter, cast(race_date as varchar) as value from r_races group by race_date
union all select 'venue', venue from r_races group by venue
union all select 'model_version', v from (values ('rule-based-v1'), ('rule-based-v1.1')) t(v)""",
    "race_card": f"""{_UP_TO_PREDICTIONS},
lp as (select * from (select *, row_number() over (partition by entry_id order by as_of_at desc, model_version desc) as rn from preds) x where rn = 1),
lf as (select * from (select *, row_number() over (partition by entry_id order by as_of_at desc) as rn from feat) x where rn = 1)
select e.race_id, e.entry_id, 1 + (e.horse_number - 1) % 8 as frame_number, e.horse_number, cast(e.assigned_weight as double) as assigned_weight,
  e.body_weight, e.body_weight_diff, e.status as entry_status, e.available_at, p_name as horse_name,
  case p_size % 3 when 0 then 'male' when 1 then 'female' else 'gelding' end as horse_sex, s_name as jockey_name,
  'Trainer ' || e.trainer_id as trainer_name, case when e.trainer_id % 2 = 0 then '美浦' else '栗東' end as trainer_affiliation,
  x.finish_position, x.finish_status, x.finish_time_ms as finish_time_milliseconds, cast(x.final_odds as double) as final_odds,
  x.status as result_status, {_WEIGHT_LABEL} as body_weight_label, {_TIME_LABEL} as finish_time_label, {_FINISH_LABEL} as finish_label,
  lf.as_of_at as features_as_of_at, lf.as_of_at + interval 1 hour as features_generated_at, {_columns('', 'lf.')}, lp.prediction_score, lp.rank_in_race, lp.as_of_at as prediction_as_of_at
from r_entries e join part on p_partkey = e.horse_id join supplier on s_suppkey = e.jockey_id
left join r_results x on x.entry_id = e.entry_id left join lf on lf.entry_id = e.entry_id left join lp on lp.entry_id = e.entry_id""",
    "feature_batch_detail": f"""{_BOTH}
select 'batch@' || strftime(as_of_at, '%Y-%m-%d') as batch_id, count(*) * 23 as generated_feature_count,
  count(distinct race_id) as target_race_count, count(distinct entry_id) as target_entry_count from vis group by as_of_at""",
    "feature_key_counts": f"""{_BOTH_FEATURES}
select 'batch@' || strftime(as_of_at, '%Y-%m-%d') as batch_id, feature_key, count(*) as snapshot_count from {_long('feat')} x group by all""",
    "prediction_runs_list": f"""{_UP_TO_EVALUATIONS}
select r.run_id, r.prediction_type, r.model_version, r.as_of_at, r.total_count, r.status, r.started_at, coalesce(e.n, 0) as evaluation_count,
  case when coalesce(e.n, 0) = 0 then '未評価' when e.n < r.total_count then '一部評価済み ' || e.n || '/' || r.total_count else '評価済み' end as evaluation_label
from runs r left join (select run_id, count(*) as n from evals group by run_id) e on e.run_id = r.run_id""",
    "run_totals": f"""{_UP_TO_EVALUATIONS}
select p.run_id, count(*) as prediction_count, count(distinct p.race_id) as target_race_count, count(e.prediction_id) as evaluation_count
from preds p left join evals e on e.prediction_id = p.prediction_id group by p.run_id""",
    "prediction_detail": f"""{_UP_TO_EVALUATIONS}
select p.prediction_id, p.entry_id, p.race_id, p.horse_id, p.jockey_id, p.run_id, p.prediction_score, p.rank_in_race,
  r.race_date, r.venue, r.race_number, r.name as race_name, n.horse_number, p_name as horse_name, s_name as jockey_name,
  e.finish_position, e.finish_status, e.is_predicted_top1, e.top_prediction_finish_position, e.top_prediction_is_top3,
  e.is_actual_winner, e.actual_winner_in_predicted_top3, e.rank_diff, e.result_available_at + interval 1 day as evaluated_at
from preds p join r_races r on r.race_id = p.race_id join r_entries n on n.entry_id = p.entry_id join part on p_partkey = p.horse_id
left join supplier on s_suppkey = p.jockey_id left join evals e on e.prediction_id = p.prediction_id""",
    "race_summary": f"""{_UP_TO_EVALUATIONS}
select run_id, race_id, top_prediction_finish_position, top_prediction_is_top3, actual_winner_in_predicted_top3
from evals where is_predicted_top1""",
    "reason_summary": f"{_UP_TO_PREDICTIONS},{_ALL_COMPONENTS}, r as ({_REASONS}) select * from r where place <= 3",
    "import_batches_list": f"""with {_BATCHES}
select * from batches where mode = 'import' and status = 'succeeded' order by started_at desc limit 20""",
    "run_history": f"""with {_BATCHES}
select batch_id, case when month(started_at) = 6 then 'running' else status end as status,
  case when month(started_at) <> 6 then started_at + interval 1 hour end as finished_at,
  case when month(started_at) = 6 then 0 else total_rows end as total_rows from batches""",
    "report_labels": f"""with {_ENTRIES}
select e.entry_id, {_WEIGHT_LABEL} as body_weight_label, {_TIME_LABEL} as finish_time_label, {_FINISH_LABEL} as finish_label
from r_entries e left join r_results x on x.entry_id = e.entry_id""",
    "resolve_references": f"""with {_ENTRIES},{_RESOLVED},
known as (select *, {_uuid("'star:race_entry:E' || entry_id")} as eid from checked)
select 'race_entry' as entity_type, 'E' || entry_id as source_id, case when missing <> '' then 'error: ' || missing else
  concat_ws('|', eid, {_uuid("'star:race:R' || race_id")}, {_uuid("'star:horse:H' || horse_id")},
    {_uuid("'star:jockey:J' || jockey_id")}, {_uuid("'star:trainer:T' || trainer_id")}) end as outcome from known
union all
select 'race_result', 'Z' || x.entry_id, case when k.missing <> '' then 'error: source_entry_id=E' || x.entry_id
  else {_uuid("'star:race_result:Z' || x.entry_id")} || '|' || k.eid end
from r_results x join known k on k.entry_id = x.entry_id""",
    "provider_infer": "select case when count(*) > 0 then 'star' else 'csv' end as provider_code from part",
    "import_summary": f"""with {_TABLES}
select 'races.sample.csv' as file, 'race' as entity_type, count(*) as read, count(*) filter (not ({_FAULTY})) as valid,
  count(*) filter (not ({_FAULTY})) as upserted from r_races
union all select 'horses.sample.csv', 'horse', count(*), count(*), count(*) from part
union all select 'jockeys.sample.csv', 'jockey', count(*), count(*), count(*) from supplier
union all select 'trainers.sample.csv', 'trainer', count(distinct s_suppkey % 7), count(distinct s_suppkey % 7), count(distinct s_suppkey % 7) from supplier
union all select 'race_entries.sample.csv', 'race_entry', count(*), count(*), count(*) from r_entries
union all select 'race_results.sample.csv', 'race_result', count(*), count(*), count(*) from r_results""",
    "upsert_natural_key": f"with {_RACES},{_MERGED_RACES} select race_date, venue, race_number, race_id, name, status from merged",
    "upsert_follow": f"""with {_TABLES},{_MERGED_RACES}
select e.entry_id, m.race_id from r_entries e join r_races r on r.race_id = e.race_id
join merged m on m.race_date = r.race_date and m.venue = r.venue and m.race_number = r.race_number""",
    "upsert_counts": f"""with {_RACES},{_MERGED_RACES},
n as (select count(*) as inserted from incoming i anti join stored s on s.race_date = i.race_date and s.venue = i.venue and s.race_number = i.race_number)
select inserted, (select count(*) from r_races) - inserted as updated, 0 as skipped from n""",
    "upsert_id": f"""with {_ENTRIES}, started as (select horse_id, count(*) as n from r_entries where status = 'running' group by horse_id)
select p_partkey as horse_id, case when n is not null then 'runner ' || n else p_name end as name,
  case when n is not null then 'gelding' else case p_size % 3 when 0 then 'male' when 1 then 'female' else 'gelding' end end as sex
from part left join started on horse_id = p_partkey""",
    "insert_ignore": f"""with {_ENTRIES}, won as (
  select distinct jockey_id from r_entries e join r_results x on x.entry_id = e.entry_id where finish_position = 1)
select s_suppkey as jockey_id, case when jockey_id is not null then 'winner' else s_name end as name
from supplier left join won on jockey_id = s_suppkey""",
    "upsert_snapshots": f"""{_BOTH_FEATURES}
select feature_key, as_of_at, count(*) as snapshots,
  cast(sum(value_number + case when as_of_at = timestamp '{LATE} 00:00:00' then 1 else 0 end) as double) as value_sum
from {_long('feat')} x group by all""",
}

ORACLES["race_card_one"] = f"""
select c.*, r.race_date, r.venue, r.race_number, r.name as race_name, r.surface as race_surface, r.distance_meters, r.status as race_status,
  row_number() over (order by c.horse_number, c.entry_id) as position, k.components, k.adjusted
from ({ORACLES["race_card"]}) c
join (with {_RACES} select * from r_races) r on r.race_id = c.race_id
left join (
  {_UP_TO_PREDICTIONS}, {_ALL_COMPONENTS},
  newest as (select * from (select *, row_number() over (partition by entry_id order by as_of_at desc, model_version desc) as rn from preds) x where rn = 1)
  select n.entry_id, count(*) as components, coalesce(sum(cast(k.adjustment as decimal(18,6))), 0)::double as adjusted
  from newest n join comps k on k.entry_id = n.entry_id and k.as_of_at = n.as_of_at and k.model_version = n.model_version
  group by n.entry_id) k on k.entry_id = c.entry_id
where c.race_id = (with {_RACES} select min(race_id) from r_races)"""
ORACLES["run_detail_one"] = f"select * from ({ORACLES['prediction_detail']}) where run_id = 'rule-based-v1@{EARLY}'"
_SCORED = f"""{_BOTH_FEATURES},{_ALL_COMPONENTS}
select entry_id, as_of_at, model_version, string_agg(feature_key || '|' || label || '|' || coalesce(cast(cast(value_number as decimal(18,6)) as varchar), '')
  || '|' || coalesce(cast(value_boolean as varchar), '') || '|' || cast(cast(adjustment as decimal(18,6)) as varchar) || '|' || reason, ';' order by nth) as listed
from comps group by all"""
ORACLES["prediction_detail"] = f"""
select d.*, coalesce(c.listed, '') as score_components, case split_part(d.run_id, '@', 1)
  {" ".join(f"when '{c.model_version}' then {_d(c.base)}" for c in BUILT_IN.values())} end as base_score, '{DISCLAIMER}' as disclaimer
from ({ORACLES["prediction_detail"]}) d left join ({_SCORED}) c
  on d.prediction_id = c.model_version || ':' || epoch_us(c.as_of_at) || ':' || c.entry_id"""
ORACLES["feature_batches_list"] = f"""{_BOTH}
select 'batch@' || strftime(as_of_at, '%Y-%m-%d') as batch_id, as_of_at as started_at, count(*) * 23 as total_count, 'succeeded' as status
from vis group by all order by started_at desc limit 20"""
ORACLES["import_batch_detail"] = f"""
select * exclude (line), 'b1' as batch_id from ({ORACLES["import_errors"]}) where row_number % 3 = 1"""

_JOB_RUN = f"case when as_of_at = timestamp '{EARLY} 00:00:00' then 'early' else 'late again' end"
ORACLES["upsert_predictions"] = f"""{_BOTH_FEATURES},{_PREDICTIONS},{_ALL_COMPONENTS}
select p.prediction_id, {_JOB_RUN.replace("as_of_at", "p.as_of_at")} as run_id, 'rule_based' as prediction_type, p.model_version, p.race_id,
  p.entry_id, p.as_of_at, p.prediction_score, p.rank_in_race, coalesce(c.n, 0) as component_count,
  p.as_of_at as snapshot_as_of_at, 1 as snapshot_version
from preds p left join (select entry_id, as_of_at, count(*) as n from comps where model_version = 'rule-based-v1' group by all) c
  on c.entry_id = p.entry_id and c.as_of_at = p.as_of_at
where p.model_version = 'rule-based-v1'"""
ORACLES["upsert_evaluations"] = f"""{_UP_TO_EVALUATIONS}
select e.* replace (case when e.run_id like '%@{EARLY}' then 'early' else 'late' end as run_id), p.as_of_at
from evals e join preds p on p.prediction_id = e.prediction_id where e.run_id like 'rule-based-v1@%'"""
ORACLES["job_runs"] = f"""{_BOTH},
made as (select as_of_at, count(*) as n from vis group by as_of_at)
select {_JOB_RUN} as run, 'succeeded' as status, 'import' as mode, as_of_at, n as total_count, n as success_count, 0 as failure_count,
  case when as_of_at = timestamp '{EARLY} 00:00:00' then n else 0 end as inserted,
  case when as_of_at = timestamp '{EARLY} 00:00:00' then 0 else n end as updated from made
union all select 'late', 'succeeded', 'import', as_of_at, n, n, 0, n, 0 from made where as_of_at = timestamp '{LATE} 00:00:00'
union all select strftime(as_of_at, '%Y-%m-%d'), 'succeeded', 'import', as_of_at, n * 23, n * 23, 0, n * 23, 0 from made"""
ORACLES["feature_definitions"] = f"""{_BOTH_FEATURES},
known as (select feature_key, count(value_number) + count(value_boolean) as n from {_long('feat')} x group by feature_key)
select d.feature_key, 1 as version, d.value_type, n as value_count
from (values {", ".join(f"('{f.key}', '{f.value_type}')" for f in registry.ALL)}) d(feature_key, value_type) join known k on k.feature_key = d.feature_key"""
_CLOSURE = f"""{_TABLES},
lost as (
  select e.*, concat_ws(', ', case when {_FAULTY.replace("race_id", "e.race_id")} then 'source_race_id=R' || e.race_id end,
    case when e.horse_id % 89 = 0 then 'source_horse_id=X' || e.horse_id end,
    case when e.jockey_id % 37 = 0 then 'source_jockey_id=X' || e.jockey_id end) as missing from r_entries e),
closure as (
  select 'races.sample.csv' as file_name, 'race' as entity_type, 'R' || race_id as source_id, 'VALIDATION_ERROR' as error_code, error_message
  from ({" union all ".join(f"select race_id, '{column}: {reason}' as error_message from r_races where race_id % {by} = 0" for column, by, reason in _FAULTS)})
  union all select 'race_entries.sample.csv', 'race_entry', 'E' || entry_id, 'REFERENCE_ERROR', missing from lost where missing <> ''
  union all select 'race_results.sample.csv', 'race_result', 'Z' || x.entry_id, 'REFERENCE_ERROR', 'source_entry_id=E' || x.entry_id
  from r_results x join lost l on l.entry_id = x.entry_id where missing <> '')"""
ORACLES["partial_import"] = f"with {_CLOSURE} select * from closure"
ORACLES["import_dry_run"] = f"""with {_CLOSURE},
files as ({ORACLES["import_summary"]}),
failed as (select count(*) filter (error_code = 'VALIDATION_ERROR') as whole, count(distinct source_id) as partial from closure)
select b.batch_id, 'dry_run' as mode, b.status, b.provider_code, (select sum(read) from files)::bigint as total_rows, 0 as inserted_rows,
  case b.batch_id when 'whole' then whole else partial end as failed_rows, file, entity_type, read, valid, 0 as upserted
from files, failed, (values ('whole', 'failed', 'csv'), ('partial', 'succeeded', 'star')) b(batch_id, status, provider_code)"""
_SEEN = f"""{_RACES},
stored as (
  select race_date, venue, race_number, min(race_id) as race_id, arg_max(name, race_id) as name, arg_max(status, race_id) as status,
    arg_max(observed_at, race_id) as observed_at
  from r_races where status = 'confirmed' group by race_date, venue, race_number),
seen as (
  select race_date, venue, race_number, race_id, name || ' (seen)' as name, status,
    case when race_id % 3 = 0 then observed_at - interval 30 day else observed_at end as observed_at from r_races),
last as (
  select *, min(race_id) over (partition by race_date, venue, race_number) as first_id from seen
  qualify row_number() over (partition by race_date, venue, race_number order by observed_at desc, race_id desc) = 1)"""
_SAME_RACE = "s.race_date = l.race_date and s.venue = l.venue and s.race_number = l.race_number"
ORACLES["upsert_newer"] = f"""with {_SEEN}
select l.race_date, l.venue, l.race_number, coalesce(s.race_id, l.first_id) as race_id,
  case when s.observed_at > l.observed_at then s.name else l.name end as name,
  case when s.observed_at > l.observed_at then s.status else l.status end as status,
  case when s.observed_at > l.observed_at then s.observed_at else l.observed_at end as observed_at
from last l left join stored s on {_SAME_RACE}"""
ORACLES["upsert_newer_counts"] = f"""with {_SEEN},
met as (select l.*, s.observed_at as was from seen l left join stored s on {_SAME_RACE})
select (select count(distinct (race_date, venue, race_number)) from met where was is null) as inserted,
  (select count(*) from met where was is null or observed_at >= was) - (select count(distinct (race_date, venue, race_number)) from met where was is null) as updated,
  (select count(*) from met where observed_at < was) as skipped"""

ORACLES["near_distance"] = f"""{_ONE}
select t.entry_id, t.race_id, t.horse_id, t.jockey_id, min(p.ms) as horse_best_time_near_distance_ms,
  count(p.ms) as horse_best_time_near_distance_count
from vis t left join past p on p.horse_id = t.horse_id and p.start_at < t.start_at and p.sc = t.sc
  and abs(p.dist - t.dist) <= 200 and p.fs = 'finished' and p.ms is not null
group by all"""
# Every entry is asked for as of its own race's start.
_OWN_START = f"""
vis as materialized (
  select e.entry_id, e.race_id, e.horse_id, e.jockey_id, r.race_date, r.start_at, r.venue,
    case when contains(r.surface, '芝') then 'turf' when contains(r.surface, 'ダート') then 'dirt' else 'other' end as sc,
    r.distance_meters as dist, r.track_condition as cond, r.start_at as as_of_at, greatest(r.available_at, e.available_at) as shown
  from r_entries e join r_races r on e.race_id = r.race_id),
past as materialized (
  select v.*, x.finish_position as pos, x.finish_status as fs, x.finish_time_ms as ms, x.available_at as ra, x.observed_at as ro
  from vis v join r_results x on x.entry_id = v.entry_id where x.available_at <= timestamp '{LATE} 00:00:00'),
""" + _HORSE.strip().replace("p.as_of_at = t.as_of_at and p.start_at < t.start_at", "p.start_at < t.start_at and p.ra <= t.start_at and p.shown <= t.start_at")
ORACLES["training_table"] = f"""with {_TABLES},{_OWN_START},
jockeys as (
  select t.entry_id,
    count(p.ra) filter (p.venue = t.venue) as v_n, count(p.ra) filter (p.venue = t.venue and p.pos = 1) as v_1,
    count(p.ra) filter (p.venue = t.venue and p.pos <= 3) as v_3, count(p.ra) filter (p.dist = t.dist) as d_n,
    count(p.ra) filter (p.dist = t.dist and p.pos = 1) as d_1, count(p.ra) filter (p.dist = t.dist and p.pos <= 3) as d_3
  from vis t left join past p on p.jockey_id = t.jockey_id and p.start_at < t.start_at and p.ra <= t.start_at and p.shown <= t.start_at
    and (p.venue = t.venue or p.dist = t.dist)
  group by t.entry_id),
feat as (
  select h.*, v_n as jockey_venue_starts, v_1 as jockey_venue_wins, v_3 as jockey_venue_top3,
    {_rate('v_1', 'v_n')} as jockey_venue_win_rate, {_rate('v_3', 'v_n')} as jockey_venue_top3_rate,
    d_n as jockey_distance_starts, d_1 as jockey_distance_wins, d_3 as jockey_distance_top3,
    {_rate('d_1', 'd_n')} as jockey_distance_win_rate, {_rate('d_3', 'd_n')} as jockey_distance_top3_rate
  from hf h join jockeys j on j.entry_id = h.entry_id)
select f.entry_id, f.race_id, f.horse_id, f.jockey_id, f.as_of_at, {_columns('')}, p.pos as label_finish_position,
  case when p.entry_id is not null then coalesce(p.pos = 1, false) end as label_is_win,
  case when p.entry_id is not null then coalesce(p.pos <= 3, false) end as label_is_top3
from feat f join vis v on v.entry_id = f.entry_id left join past p on p.entry_id = f.entry_id
where v.shown <= v.start_at and v.start_at <= timestamp '{LATE} 00:00:00'"""
_RANKED = f"""{_UP_TO_BASE},
seen as (select b.*, e.finish_position, p.prediction_score from base b join preds p on p.prediction_id = b.prediction_id
  left join evals e on e.prediction_id = b.prediction_id)"""
ORACLES["rank_diff_median"] = f"""{_RANKED}
select model_version, count(rank_diff) as evaluated_prediction_count, median(rank_diff)::double as median_rank_diff
from seen where rank_diff is not null group by model_version"""
ORACLES["position_by_rank"] = f"""{_RANKED}
select model_version, rank_in_race, count(*) as placed_count, {_r4("sum(finish_position)::double / count(*)")} as average_finish_position
from seen where finish_position is not null group by all"""
ORACLES["score_bands"] = f"""{_RANKED}
select model_version, (floor(prediction_score / 10) * 10)::int as score_from, count(*) as evaluated_prediction_count,
  count(*) filter (finish_position <= 3) as top3_count, {_r4("count(*) filter (finish_position <= 3)::double / count(*)")} as top3_rate
from seen where done group by all"""
_LEVELS = " union all ".join(
    f"select model_version, '{level}' as level, {value} as level_value, {_METRICS} from placed_base group by all"
    for level, value in (
        ("all", "null::varchar"), ("venue", "venue"), ("surface_class", "sc"),
        ("distance_band", "case when dist < 1400 then 'short' when dist < 2000 then 'middle' else 'long' end"),
    )
)
ORACLES["version_report"] = f"""{_UP_TO_BASE},
placed_base as (select b.*, r.venue, r.distance_meters as dist,
    case when contains(r.surface, '芝') then 'turf' when contains(r.surface, 'ダート') then 'dirt' else 'other' end as sc
  from base b join r_races r on r.race_id = b.race_id)
select * exclude (top1_evaluated_race_count), {_SMALL} from ({_LEVELS}) x"""

ORACLES["races_page_after"] = f"""with {_RACES}
select race_id, race_date, venue, race_number, name, start_at as scheduled_start_at, surface, distance_meters, status, observed_at
from r_races where start_at >= timestamp '1996-01-01 00:00:00' order by start_at, race_number, race_id limit 12 offset 1"""


def _broken(key: str, faults: list[tuple[str, int]]) -> str:
    """The columns that fail, in the order of the rules."""
    return "concat_ws(',', " + ", ".join(f"case when {key} % {by} = 0 then '{column}' end" for column, by in faults) + ")"


# A horse divisible by 89 is written under another letter, which changes nothing here.
ORACLES["validate_entries"] = f"""with {_ENTRIES}
select 'E' || entry_id as source_id,
  {_broken("horse_id", [("observed_at", 31), ("source_jockey_id", 29), ("frame_number", 7), ("horse_number", 11), ("assigned_weight", 13), ("body_weight", 17), ("body_weight_diff", 19), ("status", 23)])} as failed_columns,
  case when horse_id % 7 <> 0 then 1 + (horse_number - 1) % 8 end as frame_number, case when horse_id % 11 <> 0 then horse_number end as horse_number,
  case when horse_id % 13 <> 0 then assigned_weight::double end as assigned_weight, case when horse_id % 17 <> 0 then body_weight end as body_weight,
  case when horse_id % 19 <> 0 then body_weight_diff end as body_weight_diff, case when horse_id % 23 <> 0 then status end as status
from r_entries"""
ORACLES["validate_results"] = f"""with {_ENTRIES}
select 'Z' || entry_id as source_id,
  {_broken("entry_id", [("finish_position", 7), ("finish_status", 11), ("finish_time_milliseconds", 13), ("final_odds", 17), ("popularity", 19), ("status", 23)])} as failed_columns,
  case when entry_id % 7 <> 0 then finish_position end as finish_position, case when entry_id % 11 <> 0 then finish_status end as finish_status,
  case when entry_id % 13 <> 0 then finish_time_ms end as finish_time_milliseconds, case when entry_id % 17 <> 0 then final_odds::double end as final_odds,
  null::bigint as popularity, case when entry_id % 23 <> 0 then status end as status
from r_results"""
ORACLES["failed_runs"] = f"select * from ({ORACLES['prediction_runs_list']}) where status = 'failed'"
ORACLES["list_totals"] = f"""{_UP_TO_PREDICTIONS},{_BATCHES},
listed as (
  select 'imports' as list_name, count(*) as total_count from batches
  union all select 'succeeded imports', count(*) from batches where mode = 'import' and status = 'succeeded'
  union all select 'failed dry runs', count(*) from batches where mode = 'dry_run' and status = 'failed'
  union all select 'runs', count(*) from runs
  union all select 'failed runs', count(*) from runs where status = 'failed')
select list_name, total_count, greatest(1, ceil(total_count / 20))::bigint as total_pages from listed"""
