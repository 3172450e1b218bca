"""The roles that the test tables play, as SQL that both engines read.

``{name}`` stands for a table. Frames are events of a user, faces are embeddings, boxes are order
lines, timed texts are conversation turns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reelspark.session import table

FRAMES = """select user_id as video, cast((row_number() over (partition by user_id order by ts, event_id) - 1) * 30 as int) as frame_idx,
 case when event_type = 'error' then null else value end as v from {events}"""

FACES = "select vec_id as arrival, vec_id % 8 as video, label as identity, embedding as enc from {embeddings}"

BOXES = """select l_orderkey as video, cast(l_linenumber - 1 as int) as frame_idx,
 cast(row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as int) as det_ord,
 cast((l_partkey * 37) % 200 as double) as x1, cast((l_suppkey * 53) % 200 as double) as y1,
 cast((l_partkey * 37) % 200 + 300 as double) as x2, cast((l_suppkey * 53) % 200 + 300 as double) as y2,
 l_quantity as quantity, l_discount as discount, l_partkey as part, l_suppkey as supp from {lineitem}"""

TIMED = """select conv_id as media, turn as ord, turn * 5.0 as start_s, turn * 5.0 + length(text) / 20.0 as end_s, role, text from {conversations}"""

TAGS = """select l_orderkey as video, cast(l_linenumber - 1 as int) as frame_idx, p_partkey as tag_idx, p_brand || '_' || p_type as name,
 case when p_size % 10 = 0 then 9 else 0 end as category, l_discount * 10 as prob from {lineitem} join {part} on l_partkey = p_partkey"""

VIDEOS = """select o_orderkey as video, cast(o_custkey * 3 + 1 as int) as num_frames, cast(case when o_orderkey % 11 = 0 then 0 else 24 + (o_orderkey % 3) * 3 end as double) as fps,
 o_totalprice / 1000 as seconds from {orders}"""


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view, or any SQL over ``{table}`` names, as a DataFrame."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def duck(text: str) -> str:
    """The same SQL over the tables' own names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)
