"""Fixed values. They decide results, so they are stated once, as plain text."""

RAW_COLUMNS = (
    "track_uri", "ts", "platform", "ms_played", "track_name", "artist_name",
    "album_name", "reason_start", "reason_end", "shuffle", "skipped",
)
CRITICAL_COLUMNS = ("track_uri", "ts", "ms_played")
FILL_COLUMNS = ("track_name", "artist_name", "album_name", "reason_start", "reason_end")
TEXT_COLUMNS = ("track_name", "artist_name", "album_name", "platform", "reason_start", "reason_end")
BOOLEAN_COLUMNS = ("shuffle", "skipped")
UNKNOWN = "Unknown"
TRUE_TEXTS = ("TRUE", "T")

TS_FORMAT = "dd-MM-yyyy HH:mm"
MAX_PLAY_MS = 900_000
LONG_SKIP_MS = 240_000
OLDEST_PLAUSIBLE = "2008-01-01"
KNOWN_PLATFORMS = ("web player", "iOS", "Android", "desktop")

# First hour of each part of the day; before the first and from the last on it is night.
MORNING, AFTERNOON, EVENING, NIGHT = 6, 12, 18, 22
DAY_PARTS = ("Morning", "Afternoon", "Evening", "Night")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
PEAK_HOURS = (17, 18, 19, 20)
MORNING_COMMUTE = (7, 8, 9)
EVENING_COMMUTE = (17, 18, 19)
LATE_NIGHT = (23, 0, 1, 2, 3, 4, 5)
NIGHT_HOURS = (22, 23, 0, 1, 2, 3, 4, 5)

SKIP_BELOW_PERCENT = 30.0
SKIP_REASONS = ("nextbtn", "backbtn")
MANUAL_START_REASONS = ("clickrow", "playbtn")
HIGH_PERCENT, MEDIUM_PERCENT = 80.0, 50.0
COMPLETION_WEIGHT, NO_SKIP_WEIGHT = 0.6, 0.4

# Right-closed bins: (upper edge, label); the last one is open.
LENGTH_BINS = ((120.0, "<2min"), (180.0, "2-3min"), (240.0, "3-4min"), (300.0, "4-5min"), (None, "5min+"))
TRACK_BINS = ((5, "Rare"), (20, "Uncommon"), (50, "Popular"), (None, "Very Popular"))
ARTIST_BINS = ((10, "Niche"), (50, "Emerging"), (200, "Mainstream"), (None, "Superstar"))
SCORE_BINS = ((33.0, "Low"), (66.0, "Medium"), (100.0, "High"))

SESSION_GAP_MINUTES = 30
BINGE_TRACKS, SHORT_TRACKS = 20, 3
REVENUE_PER_HOUR = 0.004

SKIP_FEATURES = (
    "hour_of_day", "day_of_week_num", "is_weekend", "is_peak_hour", "is_late_night",
    "track_length_seconds", "track_play_count", "track_skip_rate",
    "user_skip_rate", "user_avg_completion", "user_frequency",
    "session_track_count", "track_position_in_session", "session_skip_rate",
    "platform_encoded", "time_of_day_encoded", "shuffle",
    "artist_skip_rate", "artist_play_count",
    "is_autoplay", "is_manual_start", "prev_track_skip", "rolling_5_skip_rate",
)
BASIC_SKIP_FEATURES = (
    "hour_of_day", "day_of_week_num", "is_weekend", "is_peak_hour", "is_night",
    "track_length_seconds", "is_long_track", "is_short_track", "shuffle_int",
    "platform_Android", "platform_iOS", "platform_web player",
    "reason_start_clickrow", "reason_start_trackdone", "reason_start_autoplay",
)
CLUSTER_FEATURES = (
    "total_plays", "avg_seconds_per_play", "skip_rate", "avg_completion", "avg_engagement",
    "shuffle_rate", "avg_session_length", "artist_diversity", "listening_intensity",
)
BASIC_CLUSTER_FEATURES = (
    "play_count", "avg_seconds_per_play", "skip_rate", "avg_percent_played", "shuffle_rate",
    "engagement_score",
)
