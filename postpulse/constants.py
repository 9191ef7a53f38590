"""Fixed values of the post-analytics domain, stated once and as plain text."""

from __future__ import annotations

# --- Fixed values: characters -------------------------------------------------
# The characters a Unicode-aware "\s" and str.strip() treat as space. Written out
# because neither Java's nor RE2's default "\s" covers them.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029"
    "\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# What a Unicode-aware "\w" matches: letters, numbers, underscore.
WORD_CLASS = r"\p{L}\p{N}_"

# --- Fixed values: text patterns ----------------------------------------------
MENTION_PATTERN = r"@[A-Za-z0-9_]+"
RETWEET_PATTERN = rf"RT[{SPACE_CLASS}]+"
URL_PATTERN = rf"https?://[^{SPACE_CLASS}]+"
HASHTAG_PATTERN = rf"#([{WORD_CLASS}]+)"
RETWEET_PREFIX = "RT @"
WORD_PATTERN = rf"[{WORD_CLASS}][{WORD_CLASS}']*"
NAME_PATTERN = rf"[{WORD_CLASS}]+"
LDA_WORD_PATTERN = r"[\p{L}_]+"
# A word without a closing "'s" is the group; a bare number has none.
COUNTED_WORD_PATTERN = (
    rf"[0-9]++(?:'s)?(?![{WORD_CLASS}'])"
    rf"|([{WORD_CLASS}]++(?:'(?!s(?![{WORD_CLASS}']))[{WORD_CLASS}]*+)*+)(?:'s)?"
)
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# --- Fixed values: crisis detection -------------------------------------------
# Default list. "policeflood" is one keyword: neither "police" nor "flood" alone
# counts, and "alart" is spelled so. Keywords match as substrings.
REFERENCE_KEYWORDS = (
    "emergency", "disaster", "help", "urgent", "ambulance", "policeflood",
    "earthquake", "fire", "attack", "danger", "high alart", "alart", "tsunami",
)
# The same list with "police" and "flood" as two keywords.
FIXED_KEYWORDS = (
    "emergency", "disaster", "help", "urgent", "ambulance", "police", "flood",
    "earthquake", "fire", "attack", "danger", "high alart", "alart", "tsunami",
)
CRISIS_SCALE = 1000
CRISIS_CAP = 100
# (lower bound, exclusive; level), highest first.
ALERT_THRESHOLDS = ((75, "EXTREME"), (55, "HIGH"), (25, "MODERATED"))
ALERT_DEFAULT = "Normal"

# --- Fixed values: sentiment --------------------------------------------------
POSITIVE, NEGATIVE, NEUTRAL = "Positive", "Negative", "Neutral"
SENTIMENTS = (POSITIVE, NEGATIVE, NEUTRAL)
SENTIMENT_CUTOFF = 0.1
NEGATORS = ("not", "never", "no")
NEGATION_FACTOR = -0.5
# How many words after a negator it still acts.
NEGATION_REACH = 1
SENTIMENT_METRIC_PREFIX = "sentiment_"

# --- Fixed values: post CSV ---------------------------------------------------
# header -> canonical column, in order of preference.
CSV_ALIASES = (
    ("Text", "text"),
    ("text", "text"),
    ("Tweet", "text"),
    ("Tweet-Text", "text"),
    ("Date", "created_at"),
    ("DateTime", "created_at"),
    ("Time", "created_at"),
    ("Timestamp", "created_at"),
    ("User", "username"),
    ("Username", "username"),
    ("ScreenName", "username"),
    ("Author", "username"),
    ("Retweets", "retweet_count"),
    ("Likes", "like_count"),
    ("Favorites", "like_count"),
    ("Country", "location"),
    ("Location", "location"),
    ("Place", "location"),
    ("Source", "platform"),
    ("Device", "platform"),
    ("Hashtags", "hashtags"),
    ("hashtags", "hashtags"),
)
# Columns added when the file lacks them; created_at becomes the import time.
CSV_DEFAULTS = (
    ("created_at", None),
    ("retweet_count", "0"),
    ("like_count", "0"),
    ("username", "unknown"),
    ("user_followers", "0"),
    ("location", None),
    ("platform", "twitter"),
    ("hashtags", ""),
)
# Cell texts a pandas CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
UNKNOWN_USER = "unknown"
DEFAULT_PLATFORM = "twitter"
# Normalised locations that mean "none given".
EMPTY_LOCATIONS = ("", "UNKNOWN", "NONE", "NULL")
# Timestamp spellings read besides ISO 8601, tried in this order.
TIMESTAMP_FORMATS = (
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy",
    "MMM d yyyy H:mm:ss", "MMM d yyyy H:mm", "MMM d yyyy",
    "MMM d, yyyy H:mm:ss", "MMM d, yyyy H:mm", "MMM d, yyyy",
    "d MMM yyyy H:mm:ss", "d MMM yyyy H:mm", "d MMM yyyy",
    "MMM d H:mm:ss Z yyyy",
    "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
)

# --- Fixed values: API and runs -----------------------------------------------
API_RESULTS_MIN, API_RESULTS_MAX, API_RESULTS_DEFAULT = 10, 100, 20
REFRESH_MINUTES_MIN, REFRESH_MINUTES_MAX, REFRESH_MINUTES_DEFAULT = 15, 120, 80
RUN_SECONDS = 3600

# --- Fixed values: sizes of the ranked views ----------------------------------
TOP_HASHTAGS, TOP_USERS, TOP_INFLUENCERS = 10, 5, 10
TOP_ENTITIES, TOP_LOCATIONS, TOP_TOPICS = 20, 5, 10
CRISIS_SAMPLE, TOP_WORDS = 15, 200
# Places: what stands between words, and how short a spelling with an error may be.
PLACE_SEPARATORS = r"[\s,;/|()]+"
TYPING_ERROR_LENGTH = 5
# Score from which a pair of words is more than chance.
COLLOCATION_THRESHOLD = 30.0
LDA_TOPICS, LDA_WORDS, LDA_SEED = 3, 10, 42
LDA_WORD_LENGTHS = (2, 15)
# A run of letters of these lengths is the group; another run has none.
LDA_TOKEN_PATTERN = (
    rf"(\p{{L}}[\p{{L}}_]{{{LDA_WORD_LENGTHS[0] - 1},{LDA_WORD_LENGTHS[1] - 1}}}+)(?![\p{{L}}_])"
    r"|[\p{L}_]++"
)

# --- Fixed values: default lexicon and stop words (ours) ----------------------
LEXICON = {
    # strongly positive
    "amazing": 0.9, "awesome": 1.0, "best": 1.0, "brilliant": 0.9,
    "delightful": 1.0, "excellent": 1.0, "fantastic": 0.9, "great": 0.8,
    "incredible": 0.9, "magnificent": 1.0, "outstanding": 0.9, "perfect": 1.0,
    "superb": 1.0, "wonderful": 1.0,
    # positive
    "beautiful": 0.8, "better": 0.5, "calm": 0.3, "clean": 0.4, "clear": 0.2,
    "cool": 0.4, "easy": 0.4, "effective": 0.6, "enjoy": 0.4, "exciting": 0.5,
    "fair": 0.6, "fast": 0.2, "fine": 0.4, "free": 0.4, "fresh": 0.3,
    "friendly": 0.5, "fun": 0.4, "glad": 0.5, "good": 0.7, "happy": 0.8,
    "helpful": 0.5, "honest": 0.6, "hope": 0.3, "impressive": 0.8,
    "interesting": 0.5, "kind": 0.6, "like": 0.2, "love": 0.5, "lovely": 0.6,
    "lucky": 0.4, "nice": 0.6, "pleased": 0.5, "popular": 0.6, "positive": 0.3,
    "proud": 0.7, "reliable": 0.6, "safe": 0.5, "smart": 0.3, "strong": 0.4,
    "success": 0.4, "super": 0.4, "thanks": 0.3, "useful": 0.4, "win": 0.7,
    # negative
    "afraid": -0.6, "angry": -0.5, "annoying": -0.7, "bad": -0.7,
    "boring": -0.9, "broken": -0.4, "complicated": -0.4, "confusing": -0.4,
    "cruel": -0.9, "dangerous": -0.6, "dead": -0.3, "difficult": -0.5,
    "dirty": -0.6, "fail": -0.6, "failed": -0.6, "fake": -0.5, "false": -0.4,
    "hard": -0.3, "hate": -0.8, "late": -0.3, "lost": -0.3, "mad": -0.6,
    "mean": -0.3, "negative": -0.3, "painful": -0.7, "poor": -0.4,
    "problem": -0.3, "sad": -0.5, "scared": -0.5, "sick": -0.7, "slow": -0.3,
    "sorry": -0.5, "strange": -0.2, "stupid": -0.8, "ugly": -0.7,
    "unfair": -0.5, "unhappy": -0.6, "useless": -0.5, "weak": -0.4,
    "wrong": -0.5,
    # strongly negative
    "awful": -1.0, "disgusting": -1.0, "dreadful": -1.0, "horrible": -1.0,
    "nasty": -1.0, "terrible": -1.0, "worst": -1.0,
}
STOPWORDS = (
    "a", "about", "after", "again", "all", "also", "an", "and", "any", "are",
    "as", "at", "be", "because", "been", "before", "being", "but", "by", "can",
    "could", "did", "do", "does", "down", "each", "else", "few", "for", "from",
    "get", "had", "has", "have", "he", "her", "here", "hers", "him", "his",
    "how", "http", "https", "i", "if", "in", "into", "is", "it", "its", "just",
    "like", "me", "more", "most", "my", "no", "nor", "not", "of", "off", "on",
    "once", "only", "or", "other", "our", "out", "over", "own", "same", "she",
    "should", "since", "so", "some", "such", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "why", "will", "with", "would", "you",
    "your",
)
