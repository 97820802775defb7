"""Layouts of the inputs, dimensions and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Event names.
EVENTS = {"launch": "e_l", "page_view": "e_pv", "order": "e_sod", "search": "e_s", "cart": "e_cart", "end": "e_e"}
#: Request keys of a log line.
REQUEST_KEYS = ["en", "uid", "sid", "mid", "pl", "ver", "b_usa", "url", "tt"]
#: Markers.
UNKNOWN, ALL = "unknown", "all"

EVENT_LOG = "row_key string, en string, uid string, sid string, mid string, pl string, ver string, ip string, s_time bigint, url string, tt string, kw string, b_n string, b_v string, os_n string, os_v string, country string, province string, city string, gid bigint, c_id bigint"
IP_RULE = "start_text string, end_text string, start_ip bigint, end_ip bigint, continent string, country string, province string, city string, district string, isp string, area_code string, english string, country_code string, longitude double, latitude double"
TASK = "task_id bigint, task_param string"
DATE_DIMENSION = "id int, year int, season int, month int, week int, day int, calendar date, type string"
LOCATION_DIMENSION = "id int, country string, province string, city string"
VISIT_BUCKETS = ["1s_3s", "4s_6s", "7s_9s", "10s_30s", "30s_60s", "1m_3m", "3m_10m", "10m_30m", "30m"]
STEP_BUCKETS = ["1_3", "4_6", "7_9", "10_30", "30_60", "60"]
SESSION_STAT = "task_id bigint, session_count bigint, " + ", ".join(f"`{b}` double" for b in VISIT_BUCKETS + STEP_BUCKETS)
TOP5_CATEGORY = "task_id bigint, category_id bigint, click_count bigint, cart_count bigint, pay_count bigint"
AREA_TOP3 = "task_id bigint, area string, product_id bigint, product_name string, city_infos string, click_count bigint"
LOCATION_FLOW = "date_dimension_id int, location_dimension_id int, nu int, uv int, pv int, sn int, `on` int, created date"
HOT_KEYWORD = "rank int, day string, country string, province string, city string, keyword string, count int"


def as_layout(df: DataFrame, layout: str) -> DataFrame:
    """The columns of a layout, in its order and types; what df lacks raises."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(layout)])
