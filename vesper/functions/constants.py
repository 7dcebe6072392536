"""Names, hour windows, keyword groups, thresholds and file names that results depend on."""

from __future__ import annotations

# Label columns and keys.
TARGETS = ("Q1", "Q2", "Q3", "S1", "S2", "S3", "S4")
KEYS = ("subject_id", "sleep_date", "lifelog_date")

# Hours of each named window; windows overlap.
WINDOWS = {
    "daily_00_24": range(0, 24),
    "day_09_18": range(9, 18),
    "evening_18_21": range(18, 21),
    "prebed_21_24": range(21, 24),
    "sleep_21_09": [21, 22, 23, *range(0, 9)],
    "late_00_03": range(0, 3),
    "deep_03_06": range(3, 6),
    "wake_06_09": range(6, 9),
}
PERIODS = {"night": range(0, 6), "morning": range(6, 12), "day": range(12, 18), "evening": range(18, 24)}

# Ordered window pairs whose statistics are compared.
PAIRS = [
    ("prebed_21_24", "sleep_21_09"),
    ("sleep_21_09", "wake_06_09"),
    ("late_00_03", "deep_03_06"),
    ("deep_03_06", "wake_06_09"),
    ("day_09_18", "evening_18_21"),
    ("evening_18_21", "prebed_21_24"),
]

# Parts of lower-case sound labels by group.
AMBIENCE = {
    "speech": ("speech", "conversation", "narration", "monologue"),
    "silence": ("silence",),
    "music": ("music", "television"),
    "vehicle": ("vehicle", "car", "truck", "motor vehicle"),
    "outdoor": ("outside", "wind", "rural", "urban", "natural"),
    "sleep_noise": ("breathing", "snoring", "white noise", "mechanical fan"),
}

# Parts of lower-case app names by category, first match wins; a leading space anchors at a word's start.
APPS = {
    "social": ("카카오톡", "instagram", "threads", " x", " twitter", "facebook"),
    "media": ("youtube", "tiktok", "웹툰", "music", "netflix", "영상", "뮤직"),
    "communication": ("통화", "전화", "메시지", "message", "mail", "gmail"),
    "game": ("game", "게임", "클래시", "royal", "number match", "whiteout", "merge"),
    "finance_shopping": ("토스", "카드", "pay", "쿠팡", "당근", "쇼핑", "bank", "은행"),
    "routine_health": ("캐시워크", "withings", "시계", "health", "헬스", "만보기"),
    "browser_search": ("naver", "chrome", "삼성 인터넷", "browser", "검색"),
    "camera_gallery": ("카메라", "갤러리", "photo", "camera"),
    "system_home": ("one ui", "시스템 ui", "launcher", "홈"),
}
OTHER_APP = "other"

# Thresholds.
RATIO_LIMIT = 12
WIFI_FAMILIAR, BLE_FAMILIAR = 20, 8
STRONG_SIGNAL = -65
EPSILON = 1e-6
ZSCORE_EPSILON = 1e-8
PROBABILITY_CLIP = 1e-4
SHRINK = (0.0, 0.15, 0.25, 0.35, 0.5, 0.75, 1.0)
ROLLING_MASKS = {"last_quarter_by_subject": 0.75, "last_third_by_subject": 2 / 3, "last_fifth_by_subject": 0.80}

# Sensor tables and their payload.
SENSORS = {
    "mACStatus": "m_charging",
    "mActivity": "m_activity",
    "mAmbience": "m_ambience",
    "mBle": "m_ble",
    "mGps": "m_gps",
    "mLight": "m_light",
    "mScreenStatus": "m_screen_use",
    "mUsageStats": "m_usage_stats",
    "mWifi": "m_wifi",
    "wHr": "heart_rate",
    "wLight": "w_light",
    "wPedo": "step",
}
