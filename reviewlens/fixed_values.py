"""Word lists and limits that results depend on.

Every value here is a fixed value: changing one changes which opinions are found.
"""

# Seed features, matched anywhere inside a feature word.
SEED_FEATURES = [
    "品牌", "型号",
    "机身", "颜色", "长度", "宽度", "厚度", "重量", "材质",
    "系统", "版本",
    "芯片", "cpu", "频率", "核数",
    "SIM", "网络", "G", "移动", "联通", "电信",
    "存储", "ROM", "RAM", "GB",
    "屏幕", "尺寸", "分辨率",
    "摄像头", "数量", "光圈", "像素",
    "电池", "容量", "拆卸", "充电器", "mA",
    "数据", "USB", "接口", "红外", "WIFI", "NFC", "蓝牙", "热点", "耳机", "充电",
    "GPS", "指纹", "陀螺仪",
    "包装", "售后", "服务", "手机", "取卡针", "保护",
]

# Negating adverbs and adversative openers, matched anywhere inside a word.
NEGATION_WORDS = ["不", "没"]
ADVERSATIVE_WORDS = ["但是", "然而", "只是", "可是", "不过", "但", "不料"]

# Dependency relations and parts of speech.
PAIR_RELATIONS = ["SBV", "VOB", "ATT", "CMP"]
DEPENDENT_FIRST = ["ATT", "SBV"]
COORDINATION = "COO"
ADVERBIAL = "ADV"
FEATURE_POS = ["n", "v"]
SENTIMENT_POS = "a"
ADVERSATIVE_POS = ["c", "d"]

# Word length limits in code points, and the vocabulary threshold.
FEATURE_LENGTH = (2, 4)
SENTIMENT_LENGTH = (1, 3)
VOCABULARY_THRESHOLD = 3

# Comment cleaning.
CONTENT_LENGTH = (4, 100)
MAX_REPEAT_RATIO = 0.5
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
NEWLINE_MARK = "。"

# Decision thresholds and report sizes.
GOOD_DEGREE = 0.5
GOOD_SCORE = 3
HOT_TAGS = 100
STOP_WORDS = 10
POSITIVE_RATING = 5
NEGATIVE_BELOW = 4
PAGE_SIZE = 10
CACHE_DAYS = 30
