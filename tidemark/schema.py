"""Data model: enums, struct types and the fixed values of the public contract."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values of the contract
# ---------------------------------------------------------------------------
OPEN = "confirmed-open"
UNKNOWN_DEADLINE = "confirmed-unknown-deadline"
EXPIRED = "expired"
VERIFICATION_STATUSES = (OPEN, UNKNOWN_DEADLINE, EXPIRED)
FACT_STATUSES = ("confirmed", "not-published", "unverified", "not-applicable")
EVENT_MODES = ("online", "offline", "hybrid", "unknown")
SOURCE_KINDS = ("official", "baoyan-notice", "cs-baoyan", "other-discovery")

TIMED_GROUP = "active-timed"
UNKNOWN_GROUP = "active-unknown"
EXPIRED_GROUP = "expired"
ROW_GROUPS = (TIMED_GROUP, UNKNOWN_GROUP, EXPIRED_GROUP)
URGENCIES = ("expired", "critical", "soon", "near", "far", "unknown")

LABEL_OPEN = "开放"
LABEL_ENDED = "已结束"
STATUS_TAGS = (LABEL_OPEN, LABEL_ENDED)
STATUS_ALIASES = {"已开营": LABEL_OPEN, "已结营": LABEL_ENDED}
STALE_STATUS_TAGS = ("已开营", "已结营")
MODE_LABELS = {"online": "线上", "offline": "线下", "hybrid": "混合", "unknown": "未核验"}
FACT_LABELS = {"confirmed": "已核验", "not-published": "未公布", "unverified": "未核验", "not-applicable": "不适用"}
OFFICIAL_SOURCE_LABEL = "官方来源"
HISTORICAL_SOURCE_LABEL = "历史来源（未核验）"
NO_DESCRIPTION = "暂无补充说明"

TIER_TAGS = ("TOP2", "港三", "华五", "C9", "985", "211", "双非", "四非", "研究院", "联培")
TIER_PRIORITY = ("TOP2", "港三", "华五", "C9", "985", "211", "研究院", "联培", "双非", "四非")
RESEARCH_TIER = "研究院"
RESEARCH_NAME_PATTERN = "中国科学院|中国农业科学院|研究所|研究院|实验室|科学中心|天文台|国家空间科学中心|空间技术研究院"

# The 31 facet values in display order.  Which school lies in which province is data, see
# ``sources.dimensions.read_provinces``.
PROVINCES = (
    "北京", "浙江", "上海", "江苏", "湖北", "陕西", "广东", "四川", "黑龙江", "天津", "山东", "湖南", "福建",
    "安徽", "江西", "河南", "辽宁", "河北", "山西", "甘肃", "云南", "广西", "贵州", "新疆", "海南", "内蒙古",
    "吉林", "重庆", "青海", "宁夏", "西藏",
)

DENIED_OFFICIAL_HOSTS = ("ddl.csbaoyan.top", "github.com", "www.baoyantongzhi.com", "baoyantongzhi.com")

VIEWS = ("list", "calendar")

V1_FACT_SUMMARY = "旧版快照未记录"
LEGACY_FACT_SUMMARY = "历史归档未核验"
LEGACY_EVENT_TYPE = "历史归档"
LEGACY_SOURCE_LABEL = "历史归档来源（未核验）"
LEGACY_NO_DEADLINE = "历史数据未提供"
EXPIRED_EVENT_TYPE = "已过期活动"
OFFICIAL_LINK_LABEL = "官方链接"
NOTICE_LINK_LABEL = "保研通知网"
FEED_LABEL_PREFIX = "推免活动 "
FEED_ID_PREFIX = "camp"

# Bounds of the contract
MAX_SNAPSHOT_BYTES = 16 * 1024 * 1024
MAX_SCAN_NODES = 50_000
MAX_SCAN_DEPTH = 256
MAX_JSON_DEPTH = 512

MS_PER_SECOND = 1_000
MS_PER_MINUTE = 60_000
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000

# Key sets of the public JSON objects
CANDIDATE_KEYS = ("schemaVersion", "scanAt", "defaultFeedId", "feeds", "counts", "opportunities")
APPROVAL_KEYS = ("snapshotId", "approvedAt", "previousSnapshotId", "dataHash")
FEED_KEYS = ("id", "label", "admissionCycle", "eventYear")
COUNT_KEYS = ("confirmedOpen", "confirmedUnknownDeadline", "pendingExcluded", "expired")
OPPORTUNITY_KEYS_V1 = (
    "projectId", "feedId", "name", "institute", "project", "eventType", "description", "verificationStatus",
    "deadline", "deadlineOriginal", "deadlineEpochMs", "website", "tags", "verifiedAt", "discoverySources",
    "logistics", "recommendation", "materials",
)
OPPORTUNITY_KEYS_V2 = OPPORTUNITY_KEYS_V1 + ("eventArrangement",)
SOURCE_KEYS = ("kind", "label", "url")
FACT_KEYS = ("status", "summary")
ARRANGEMENT_KEYS = ("mode", "time", "formatLocation")
RELEASE_KEYS = ("dataHash", "releaseSha", "snapshotId")
PUBLICATION_DATASETS = ("data/approved/current.json", "data/project-id-aliases.json")

# ---------------------------------------------------------------------------
# Struct types
# ---------------------------------------------------------------------------
FACT = T.StructType([T.StructField("status", T.StringType()), T.StructField("summary", T.StringType())])
SOURCE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("url", T.StringType()),
])
ARRANGEMENT = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("time", FACT),
    T.StructField("formatLocation", FACT),
])
OPPORTUNITY = T.StructType([
    T.StructField("projectId", T.StringType()),
    T.StructField("feedId", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("institute", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("verificationStatus", T.StringType()),
    T.StructField("deadline", T.StringType()),
    T.StructField("deadlineOriginal", T.StringType()),
    T.StructField("deadlineEpochMs", T.LongType()),
    T.StructField("website", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("province", T.StringType()),
    T.StructField("verifiedAt", T.StringType()),
    T.StructField("discoverySources", T.ArrayType(SOURCE)),
    T.StructField("logistics", FACT),
    T.StructField("recommendation", FACT),
    T.StructField("materials", FACT),
    T.StructField("eventArrangement", ARRANGEMENT),
])
FEED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("admissionCycle", T.StringType()),
    T.StructField("eventYear", T.LongType()),
])
COUNTS = T.StructType([T.StructField(key, T.LongType()) for key in COUNT_KEYS])
LEGACY_ROW = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("institute", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("deadline", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("province", T.StringType()),
])

OPPORTUNITY_COLUMNS = tuple(OPPORTUNITY.fieldNames())
