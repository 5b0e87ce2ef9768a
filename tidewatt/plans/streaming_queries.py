"""The daily update as a stream over the events file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatt.plans import fixtures as X
from tidewatt.plans.diagnosis_queries import CALENDAR
from tidewatt.plans.registry import query
from tidewatt.session import shared_dir
from tidewatt.streaming import incremental as I

LAST = X.PARTS + """, last as (
  select region, time_utc, part_no, row_ord, load_mw from parts
  qualify row_number() over (partition by region, time_utc order by part_no desc, row_ord desc) = 1)"""


def update(spark, sf, features=False):
    """Stream the events through the merge in two batches that share their days; returns the target folder."""
    target = f"{shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")

    def to_panel(batch):
        typed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        return X.parts_of(typed)

    for half in (0, 1):
        # Each half is one part of every hour, so both batches hold rows of every day; the second takes up what is new.
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{target}/in")
        I.run_updates(
            spark,
            f"{target}/in",
            events.schema,
            to_panel,
            target,
            ["part_no", "row_ord"],
            features=f"{target}/features" if features else None,
        )
    return target


@query("incremental_merge", f"with {LAST} select * from last")
def _(spark, sf):
    return I.read_table(spark, f"{update(spark, sf)}/panel").drop("day")


@query(
    "incremental_features",
    f"""with {LAST}, flagged as (select p.*, h.load_mw as load_previous_week from last p
          left join last h on h.region = p.region and h.time_utc + interval 7 day = p.time_utc), {CALENDAR}
        select region, time_utc, part_no, row_ord, load_mw, load_previous_week, is_weekend, US_federal_holidays, state_holidays from marked""",
)
def _(spark, sf):
    return I.read_table(spark, f"{update(spark, sf, features=True)}/features").drop("day")
