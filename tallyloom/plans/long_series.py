"""Named queries W, D and E over rows that no calendar bounds: all events, all order lines, each in one sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import expr as e
from tallyloom.functions import series as s
from tallyloom.functions.blocks import POSITION, by_blocks, running
from tallyloom.operators.expanding import expanding_median
from tallyloom.plans.catalog import query
from tallyloom.plans.common import rounded

EVENTS = ["ts", "event_id"]
LINES = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "W02_W06_event_changes",
    """select event_id, value, lag(value, 1) over w as lag_1, lag(value, 28) over w as lag_28,
       (value - lag(value, 1) over w) / nullif(lag(value, 1) over w, 0) as pct_change
       from events window w as (order by ts, event_id)""",
)
def event_changes(t):
    def build(x, keys):
        x = x.withColumns({f"lag_{k}": s.lag("value", k, keys, POSITION) for k in (1, 28)})
        return x.withColumn("pct_change", e.ratio(F.col("value") - F.col("lag_1"), "lag_1"))

    out = by_blocks(t.base("events").select(*EVENTS, "value"), EVENTS, build, before=28)
    return out.select("event_id", "value", "lag_1", "lag_28", "pct_change")


_PAST = "(order by ts, event_id rows between 28 preceding and 1 preceding)"
_MIDST = "(order by ts, event_id rows between 182 preceding and 182 following)"


@query(
    "W03_W04_W05_event_frames",
    f"""select event_id,
       cast(sum(cast(value as decimal(18,4))) over (order by ts, event_id rows 29 preceding) as double) as sum_30,
       case when count(value) over {_MIDST} = 365 then
         cast(sum(cast(value as decimal(18,4))) over {_MIDST} as double) / 365 end as centred_365,
       case when count(value) over {_PAST} = 28 then round(stddev_samp(value) over {_PAST}, 4) end as std_28,
       case when count(value) over {_PAST} = 28 then min(value) over {_PAST} end as min_28,
       case when count(value) over {_PAST} = 28 then max(value) over {_PAST} end as max_28 from events""",
)
def event_frames(t):
    def build(x, keys):
        return x.withColumns(
            {
                "sum_30": s.trailing(F.sum(e.money("value")), 30, keys, POSITION).cast("double"),
                "centred_365": s.centred(F.sum(e.money("value")), "value", 365, keys, POSITION).cast("double") / 365,
                "std_28": s.previous(F.stddev_samp("value"), "value", 28, keys, POSITION),
                "min_28": s.previous(F.min("value"), "value", 28, keys, POSITION),
                "max_28": s.previous(F.max("value"), "value", 28, keys, POSITION),
            }
        )

    out = by_blocks(t.base("events").select(*EVENTS, "value"), EVENTS, build, before=182, after=182)
    return rounded(out.select("event_id", "sum_30", "centred_365", "std_28", "min_28", "max_28"), {"std_28": 4})


_SO_FAR = f"(partition by l_returnflag order by {', '.join(LINES)} rows unbounded preceding)"


@query(
    "D01_W08_line_running_totals",
    f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
       count(l_quantity) over {_SO_FAR} as lines_so_far,
       cast(sum(cast(l_extendedprice as decimal(18,4))) over {_SO_FAR} as double) as price_so_far,
       max(l_extendedprice) over {_SO_FAR} as largest_so_far from lineitem""",
)
def line_running_totals(t):
    lines = t.base("lineitem").select(*LINES, "l_returnflag", "l_quantity", "l_extendedprice")
    totals = {
        "lines_so_far": ("count", "l_quantity"),
        "price_so_far": ("sum", "_money"),
        "largest_so_far": ("max", "l_extendedprice"),
    }
    out = running(lines.withColumn("_money", e.money("l_extendedprice")), LINES, totals, ["l_returnflag"])
    return out.select(*LINES[1:], "l_returnflag", "lines_so_far", F.col("price_so_far").cast("double").alias("price_so_far"), "largest_so_far")


@query(
    "W11_E08_event_past_median",
    """select event_id, event_type, round(median(value) over (partition by event_type order by ts, event_id
       rows between unbounded preceding and 1 preceding) + 1e-7, 4) as past_median from events""",
)
def event_past_median(t):
    events = t.base("events").select(*EVENTS, "event_type", "value")
    out = expanding_median(events, "value", EVENTS, ["event_type"])
    return rounded(out.select("event_id", "event_type", "past_median"), {"past_median": 4}, nudge=1e-7)


@query(
    "W11_line_past_median",
    f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(median(l_extendedprice) over (partition by l_returnflag
       order by {', '.join(LINES)} rows between unbounded preceding and 1 preceding) + 1e-7, 4) as past_median from lineitem""",
)
def line_past_median(t):
    lines = t.base("lineitem").select(*LINES, "l_returnflag", "l_extendedprice")
    out = expanding_median(lines, "l_extendedprice", LINES, ["l_returnflag"])
    return rounded(out.select(*LINES[1:], "past_median"), {"past_median": 4}, nudge=1e-7)
